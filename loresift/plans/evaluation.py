"""Queries on retrieval quality, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.operators import bm25
from loresift.operators import evaluate as E
from loresift.operators.bm25 import SearchParams
from loresift.plans import standins as S
from loresift.plans.search import sql_bm25


def _results(spark: SparkSession, d: str, p: SearchParams = SearchParams()) -> DataFrame:
    docs = S.entries(spark, d).select("corpus", "doc", "pos", "text")
    return bm25.search(docs, S.queries(spark, d), p).select("query", F.col("doc").alias("item"), "rank")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return S.gold(spark, d).select("query", F.col("doc").alias("item"))


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    return E.found(_results(spark, d), _gold(spark, d))


def hit_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.averages(E.judged(_firsts(spark, d)), "k")


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.reciprocal_rank(_firsts(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rr"), 6).alias("mrr"))


def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg(_firsts(spark, d)).groupBy("k").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


def slice_by_query_length(spark: SparkSession, d: str) -> DataFrame:
    """Queries are cut to ``item % 8 + 1`` words here, so that all buckets have some."""
    q = S.queries(spark, d).select("query", E.length_bucket((F.col("query") % 8) + 1).alias("bucket"))
    rows = E.judged(_firsts(spark, d), (5,)).join(q, "query")
    return E.with_empty(E.averages(rows, "bucket"), "bucket", ("1-2", "3-5", "6+"))


def slice_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = E.judged(_firsts(spark, d), (5,)).withColumn("grp", F.col("query") % 4)
    return E.averages(rows, "grp")


def slice_by_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Whether ``manual`` stands in any of the five best references; the stand-in marks sources 0 to 4 as manual."""
    ref = F.concat(F.when(F.substring_index("source_ref", "/", 1).isin("src0", "src1", "src2", "src3", "src4"), "manual/").otherwise("auto/"), F.col("source_ref"))
    refs = S.entries(spark, d).select(F.col("doc").alias("item"), ref.alias("ref"))
    mix = _results(spark, d).where("rank <= 5").join(refs, "item").groupBy("query").agg(F.max(F.contains(F.lower("ref"), F.lit("manual")).cast("int")).alias("m"))
    rows = E.judged(_firsts(spark, d), (5,)).join(mix, "query", "left").withColumn("mix", F.when(F.coalesce("m", F.lit(0)) == 1, "with-manual").otherwise("index-only"))
    return E.with_empty(E.averages(rows, "mix"), "mix", ("with-manual", "index-only"))


def slice_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """A query counts once for each of its gold items; the language stands for the file extension."""
    ext = S.table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("ext"))
    rows = E.judged(_firsts(spark, d), (5,)).join(_gold(spark, d).join(ext, "item").select("query", "ext"), "query")
    return E.averages(rows, "ext")


def soft_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits when a retrieved text may also mention the first three words of the passage."""
    three = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("x/"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("item"))
    texts = S.entries(spark, d).select(F.col("doc").cast("string").alias("item"), "text")
    got = _results(spark, d).withColumn("item", F.col("item").cast("string")).join(texts, "item")
    firsts = E.found(got, three, E.mentioned(F.col("gold_item"), F.col("text")))
    return E.averages(E.judged(firsts), "k")


SWEEP = tuple((b, k1) for b in (0.5, 0.85) for k1 in (1.2, 1.5))


def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Postings are made once; every combination only weighs them anew."""
    docs, q, gold = S.entries(spark, d).select("corpus", "doc", "pos", "text"), S.queries(spark, d), _gold(spark, d)
    params = [SearchParams(b=b, k1=k1) for b, k1 in SWEEP]
    found = E.swept(bm25.hits(docs, q), docs, q, params)
    rows = None
    for i, p in enumerate(params):
        one = E.judged(E.found(found[i].select("query", F.col("doc").alias("item"), "rank"), gold), (5,)).agg(F.round(F.avg("hit"), 6).alias("hit_rate"))
        one = one.select(F.lit(i).cast("long").alias("combo"), F.lit(p.b).alias("b"), F.lit(p.k1).alias("k1"), "hit_rate")
        rows = one if rows is None else rows.union(one)
    return E.best_of(rows, "hit_rate")


QUERIES = {f.__name__: f for f in (hit_recall_at_k, mrr, ndcg_at_k, slice_by_query_length, slice_by_group, slice_by_source_mix, slice_by_extension, soft_hits, parameter_sweep)}

_BASE = f"{S.ENTRIES}, {S.QUERIES}, {S.GOLD}, {sql_bm25('entries', 'queries')}, top as (select query, doc, rank from ranked where rank <= 10), firsts as (select g.query, g.doc, min(case when t.doc = g.doc then rank end) f from gold g left join top t on g.query = t.query group by all)"


def _judged(ks: str) -> str:
    return f"per as (select query, k, count(*) n_gold, count(*) filter (f <= k) n_found from firsts, (select unnest([{ks}]) k) group by all), judged as (select query, k, (n_found > 0)::int hit, n_found / n_gold::double recall from per)"


_AVG = "count(*) n, round(avg(hit), 6) hit_rate, round(avg(recall), 6) mean_recall"
_FIVE = f"with {_BASE}, {_judged('5')}"


def _sweep_sql() -> str:
    parts = []
    for i, (b, k1) in enumerate(SWEEP):
        ctes = f"{sql_bm25('entries', 'queries', name=f's{i}_', p=SearchParams(b=b, k1=k1))}, s{i}_f as (select g.query, count(*) filter (r.rank <= 5) k from gold g left join s{i}_ranked r on r.query = g.query and r.doc = g.doc group by g.query)"
        parts.append((ctes, f"select {i}::bigint combo, {b}::double b, {k1}::double k1, round(avg((k > 0)::int), 6) hit_rate from s{i}_f"))
    return f"with {S.ENTRIES}, {S.QUERIES}, {S.GOLD}, {', '.join(c for c, _ in parts)}, u as ({' union all '.join(q for _, q in parts)}) select *, row_number() over (order by hit_rate desc, combo) place from u"


SQL = {
    "hit_recall_at_k": f"with {_BASE}, {_judged('1, 3, 5, 10')} select k::bigint k, {_AVG} from judged group by k",
    "mrr": f"with {_BASE}, r as (select query, coalesce(1.0::double / min(f), 0) rr from firsts group by query) select count(*) n, round(avg(rr), 6) mrr from r",
    "ndcg_at_k": f"""with {_BASE}, g as (select query, k, coalesce(sum(1 / log2(f + 1.0::double)) filter (f <= k), 0) dcg, least(count(*), k) m from firsts, (select unnest([1, 3, 5, 10]) k) group by query, k),
x as (select query, k, round(dcg / list_aggregate(list_transform(range(1, m + 1), lambda r: 1 / log2(r + 1.0::double)), 'sum'), 4) x from g) select k::bigint k, round(avg(x), 6) ndcg from x group by k""",
    "slice_by_query_length": f"{_FIVE}, b as (select case when query % 8 + 1 <= 2 then '1-2' when query % 8 + 1 <= 5 then '3-5' else '6+' end bucket, {_AVG} from judged group by 1) select n0.bucket, coalesce(n, 0) n, coalesce(hit_rate, 0) hit_rate, coalesce(mean_recall, 0) mean_recall from (select unnest(['1-2', '3-5', '6+']) bucket) n0 left join b on n0.bucket = b.bucket",
    "slice_by_group": f"{_FIVE} select query % 4 grp, {_AVG} from judged group by 1",
    "slice_by_source_mix": f"""{_FIVE}, m as (select t.query, max((split_part(source_ref, '/', 1) in ('src0', 'src1', 'src2', 'src3', 'src4'))::int) m from top t join entries e on e.doc = t.doc where rank <= 5 group by 1),
b as (select case when coalesce(m, 0) = 1 then 'with-manual' else 'index-only' end mix, {_AVG} from judged j left join m on m.query = j.query group by 1)
select n0.mix, coalesce(n, 0) n, coalesce(hit_rate, 0) hit_rate, coalesce(mean_recall, 0) mean_recall from (select unnest(['with-manual', 'index-only']) mix) n0 left join b on n0.mix = b.mix""",
    "slice_by_extension": f"{_FIVE} select lang ext, {_AVG} from judged j join gold g on g.query = j.query join documents d on d.doc_id = g.doc group by 1",
    "soft_hits": f"""with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries')}, g as (select item_id query, array_to_string(string_split(text, ' ')[:3], ' ') item from benchmark),
firsts as (select g.query, min(case when contains(e.text, g.item) then rank end) f from g left join ranked r on r.query = g.query and rank <= 10 left join entries e on e.doc = r.doc group by g.query, g.item), {_judged('1, 3, 5, 10')}
select k::bigint k, {_AVG} from judged group by k""",
    "parameter_sweep": _sweep_sql(),
}
