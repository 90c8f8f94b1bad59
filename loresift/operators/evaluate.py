"""Retrieval metrics in long form: one row for each query and cut-off, averaged by whatever slice is asked for.

``results(query, item, rank[, text])`` are rankings, ``gold(query, item)`` what should be found.  Queries without gold
are left out by ``judged``; a query without any result counts as a miss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresift.operators import bm25

KS = (1, 3, 5, 10)


def mentioned(gold: Column, text: Column) -> Column:
    """The gold name, or the last part of its path, stands anywhere in the text."""
    name = F.substring_index(gold, "/", -1)
    return F.contains(text, gold) | ((name != gold) & F.contains(text, name))


def found(results: DataFrame, gold: DataFrame, soft: Column | None = None) -> DataFrame:
    """``(query, item, first)``: the first rank at which each gold item is found; null if never.

    Strict: the item itself is retrieved.  With ``soft`` (a condition on ``gold_item`` and ``text``) a retrieved text may also mention it.
    """
    g = gold.select("query", F.col("item").alias("gold_item")).distinct()
    r = results.select("query", F.col("item").alias("got"), "rank", *(["text"] if soft is not None else []))
    same = F.col("gold_item") == F.col("got")
    hit = same if soft is None else same | soft
    return g.join(r, "query", "left").groupBy("query", "gold_item").agg(F.min(F.when(hit, F.col("rank"))).alias("first")).withColumnRenamed("gold_item", "item")


def judged(firsts: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """``(query, k, n_gold, n_found, hit, recall)`` for every query with gold and every cut-off."""
    per = firsts.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("first") <= k).alias(f"at{k}") for k in ks])
    long = per.select("query", "n_gold", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"at{k}").alias("n_found")) for k in ks])).alias("x"))
    return long.select("query", "x.k", "n_gold", "x.n_found", (F.col("x.n_found") > 0).cast("int").alias("hit"), (F.col("x.n_found") / F.col("n_gold")).alias("recall"))


def averages(rows: DataFrame, *by: str) -> DataFrame:
    """Mean hit and recall, and the number of queries, by slice."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def reciprocal_rank(firsts: DataFrame) -> DataFrame:
    """``(query, rr)``: one over the first rank with any gold item, 0 if there is none."""
    return firsts.groupBy("query").agg(F.coalesce(1.0 / F.min("first"), F.lit(0.0)).alias("rr"))


def ndcg(firsts: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """``(query, k, ndcg)`` with gain 1, rounded to four digits for each query before anything is averaged."""
    gain = lambda r: 1.0 / F.log2(r + 1.0)
    def upto(k: int) -> Column:
        return F.filter("ranks", lambda r: r <= k)

    rows = []
    per = firsts.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("first")).alias("ranks"))
    for k in ks:
        dcg = F.aggregate(upto(k), F.lit(0.0), lambda s, r: s + gain(r.cast("double")))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r.cast("double")))
        rows.append(F.struct(F.lit(k).cast("long").alias("k"), F.round(dcg / ideal, 4).alias("ndcg")))
    return per.select("query", F.explode(F.array(*rows)).alias("x")).select("query", "x.*")


def length_bucket(words: Column) -> Column:
    return F.when(words <= 2, "1-2").when(words <= 5, "3-5").otherwise("6+")


def with_empty(slices: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """A row for every named slice, with zeros where it has no queries."""
    base = slices.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return base.join(slices, column, "left").fillna(0)


def swept(hits: DataFrame, docs: DataFrame, queries: DataFrame, params: Sequence[bm25.SearchParams]) -> list[DataFrame]:
    """The ranking of each parameter set over one table of ``bm25.hits``, which is summed up for all of them in one pass."""
    sums = hits.groupBy("corpus", "query", "doc").agg(*[F.sum(bm25.part(p)).alias(f"s{i}") for i, p in enumerate(params)]).persist()
    return [bm25.ranked(docs, queries, sums.select("corpus", "query", "doc", F.col(f"s{i}").alias("score")), p.top_n, p.digits) for i, p in enumerate(params)]


def best_of(swept: DataFrame, metric: str) -> DataFrame:
    """Parameter combinations by falling ``metric``; of equal ones the earlier ``combo`` comes first."""
    return swept.withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), "combo")))  # a row for each combination
