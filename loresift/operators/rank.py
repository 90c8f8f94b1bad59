"""Ranking after scoring: filters, normalisation, fusion, diversification, sessions and suggestions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types

from loresift.functions import text as T
from loresift.functions.refs import file_of
from loresift.operators import blocks

#: Punctuation cut off a query word, as the inside of a regular expression's brackets.
EDGE_CLASS = ",.;:!?()\\[\\]{}\"'"
# Tags that nearly every indexed entry has.
NOISE_TAGS = ("index", "content", "section", "section-master", "key-file", "directory", "summary", "doc", "md", "mdx", "py", "tf")
SEEN, SIBLING = 0.3, 1.5
SUGGEST_FROM, SUGGEST_SIBLINGS, SUGGEST_TAGS = 12, 4, 5


def with_tag(entries: DataFrame, tag: str) -> DataFrame:
    """Entries that carry the tag, whatever its case; to be applied before any statistics."""
    return entries.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def low_signal(queries: DataFrame) -> DataFrame:
    """``(query, hits)`` of queries that only say what is being done: three words, two of them meta words, no identifier."""
    words = F.transform(F.filter(F.split("text", "\\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, f"^[{EDGE_CLASS}]+|[{EDGE_CLASS}]+$", ""))
    q = queries.withColumn("ws", words)
    hits = F.filter(F.transform("ws", F.lower), lambda t: t.isin(*T.META_WORDS))
    good = (F.size("ws") >= 3) & ~F.exists("ws", T.identifier_shape) & (F.size(hits) >= 2)
    return q.where(good).select("query", F.array_join(F.slice(F.sort_array(F.array_distinct(hits)), 1, 4), ", ").alias("hits"))


def minmax(score: Column, over: WindowSpec) -> Column:
    """Scores scaled to 0..1 within the window; if all are equal, 0.5."""
    lo, hi = F.min(score).over(over), F.max(score).over(over)
    return F.when(hi <= lo, 0.5).otherwise((score - lo) / (hi - lo))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double arrays; the cosine, if both have unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that meet the documents at once, and the queries of a tile of scores.
QUERY_BLOCK, TILE = 1 << 14, 256


def _vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the rows of an Arrow list column and their vectors; rows with a null in or for their vector under -1."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten(), np.cumsum(lengths)
    holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (holes[ends] == holes[ends - lengths])
    size, flat = np.where(whole, lengths, -1), flat.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (at, flat[(ends[at] - n)[:, None] + np.arange(n)] if n > 0 else np.zeros((len(at), 0))) for n, at in rows.items()}


def _nearest_of(queries: pa.Table, top_n: int, digits: int):
    """A function over batches ``(doc, pos, vec)`` that yields a task's own best documents of each query, kept from batch to batch.

    A pair without an inner product (a null, or lengths that differ) counts as below all others here, and as null after.
    """

    def run(batches):
        asked, held, docs = _vectors(queries.column("qvec").combine_chunks()), None, None
        for batch in batches:
            found, pos, base = [] if held is None else [held], batch.column("pos").to_numpy(zero_copy_only=False), 0 if docs is None else len(docs)
            there = _vectors(batch.column("vec"))
            for n, (which, vectors) in asked.items():
                rows, v = there.get(n, ([], None)) if n >= 0 else ([], None)
                for k in range(0, len(which), TILE):
                    q = vectors[k : k + TILE]
                    raw = np.full((len(q), len(pos)), -np.inf)
                    if len(rows):
                        raw[:, rows] = q @ v.T
                    i, j = blocks.candidates(raw, top_n, digits)
                    x = raw[i, j]
                    if len(rows):
                        tie, at = np.flatnonzero(blocks.near_tie(x, digits)), np.searchsorted(rows, j)
                        for t in np.array_split(tie, len(tie) // 65536 + 1):  # summed in order, as SQL does
                            x[t] = np.add.accumulate(np.c_[np.zeros(len(t)), q[i[t]] * v[at[t]]], axis=1)[:, -1]
                    x = blocks.half_up(x, digits)
                    keep = blocks.best(i, x, pos[j], top_n)
                    found.append((which[k + i[keep]], x[keep], pos[j[keep]], base + j[keep]))
            if found:
                q, x, p, place = (np.concatenate(c) for c in zip(*found, strict=True))
                keep = blocks.best(q, x, p, top_n)
                used, place = np.unique(place[keep], return_inverse=True)
                held = q[keep], x[keep], p[keep], place
                docs = (batch.column("doc") if docs is None else pa.concat_arrays([docs, batch.column("doc")])).take(pa.array(used))
        if held is not None:
            ids = queries.column("query").combine_chunks().take(pa.array(held[0]))
            yield pa.RecordBatch.from_arrays([ids, docs.take(pa.array(held[3])), pa.array(held[2]), pa.array(held[1], mask=np.isneginf(held[1]))], names=["query", "doc", "pos", "score"])

    return run


def nearest(docs: DataFrame, queries: DataFrame, top_n: int, digits: int = 4) -> DataFrame:
    """The ``top_n`` documents ``(doc, pos, vec)`` by inner product for each of ``queries(query, qvec)``.

    Every query meets all rows, ``QUERY_BLOCK`` queries at a time, in tiles of a matrix product; each task keeps its
    own best before anything is shuffled.  Products that rounding could turn either way are summed in order.
    """
    count = -(-queries.count() // QUERY_BLOCK)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    rows = docs.select("doc", F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    schema = types.StructType([types.StructField("query", queries.schema["query"].dataType), *rows.schema.fields[:2], types.StructField("score", types.DoubleType())])
    out = None
    for i in range(max(1, count)):
        some = queries if count <= 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(count)) == i)
        given = some.select("query", F.col("qvec").cast("array<double>").alias("qvec")).toArrow()  # about QUERY_BLOCK vectors
        found = rows.mapInArrow(_nearest_of(given, top_n, digits), schema)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).select("query", "doc", "score", "rank")
        out = found if out is None else out.union(found)
    return out


def fused(doc_vectors: DataFrame, query_vectors: DataFrame, scored: DataFrame, alpha: float, top_n: int, digits: int = 4) -> DataFrame:
    """The ``top_n`` documents of every query by ``(1 - alpha)`` of the scaled lexical score and ``alpha`` of the scaled cosine.

    ``doc_vectors(corpus, doc, pos, vec)``, ``query_vectors(corpus, query, qvec)``, ``scored(corpus, query, doc, score)``.  The scales
    are those of all documents of the corpus: every cosine is computed, but only minima, maxima and each task's best
    leave a task.  Candidates are the documents with a lexical score, and of the others as many as are asked for by
    the cosine, among documents with no better lexical score than 0; that is exact.
    """
    scored = scored.select("corpus", "query", "doc", "score")
    pairs = doc_vectors.join(query_vectors, "corpus").select("corpus", "query", "doc", "pos", dot(F.col("qvec"), F.col("vec")).alias("cos"))
    ends = pairs.groupBy("corpus", "query").agg(F.min("cos").alias("c0"), F.max("cos").alias("c1"), F.count(F.lit(1)).alias("n"))
    lex = scored.groupBy("corpus", "query").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("k"))
    ends = ends.join(lex, ["corpus", "query"], "left")
    some = F.coalesce("k", F.lit(0)) < F.col("n")  # some document has no lexical score
    zero = F.lit(0.0)
    ends = ends.select("corpus", "query", "c0", "c1", F.when(some, F.least(F.coalesce("lo", zero), zero)).otherwise(F.col("lo")).alias("b0"), F.when(some, F.greatest(F.coalesce("hi", zero), zero)).otherwise(F.col("hi")).alias("b1"))

    def unit(x: Column, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) <= F.col(lo), 0.5).otherwise((x - F.col(lo)) / (F.col(hi) - F.col(lo)))

    def value(bm: Column) -> Column:
        return F.round((1 - alpha) * unit(bm, "b0", "b1") + alpha * unit(F.col("cos"), "c0", "c1"), digits)

    order = Window.partitionBy("corpus", "query").orderBy(F.desc("score"), "pos")
    columns = ["corpus", "query", "doc", "pos", "score"]
    others = pairs if (below := scored.where("score < 0")).isEmpty() else pairs.join(below, ["corpus", "query", "doc"], "left_anti")
    plain = others.join(F.broadcast(ends), ["corpus", "query"]).withColumn("score", value(zero)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select(*columns)  # ends: a row for each query given
    hit = scored.withColumnRenamed("score", "bm").join(doc_vectors, ["corpus", "doc"]).join(query_vectors, ["corpus", "query"]).withColumn("cos", dot(F.col("qvec"), F.col("vec")))
    hit = hit.join(ends, ["corpus", "query"]).withColumn("score", value(F.col("bm"))).select(*columns)
    both = hit.union(plain.join(scored.select("corpus", "query", "doc"), ["corpus", "query", "doc"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def mmr(pool: DataFrame, top_k: int, lambda_: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over ``pool(query, doc, score, rank, source_ref)``, for scores that fall with the rank.

    Two entries are alike if they are of one file, so the greedy choice has a closed form: every file's later
    entries pay ``1 - lambda_`` once.  Entries without a reference are files of their own.  A pool of at most
    ``top_k`` stays as it is.  Original scores are kept.
    """
    q = Window.partitionBy("query")
    own = F.when(F.coalesce("source_ref", F.lit("")) == "", F.concat(F.lit("#"), F.col("doc").cast("string"))).otherwise(file_of(F.col("source_ref")))
    later = (F.row_number().over(Window.partitionBy("query", "_file").orderBy("rank")) > 1).cast("int")
    value = lambda_ * minmax(F.col("score"), q) - (1 - lambda_) * later
    pool = pool.withColumn("_file", own).withColumn("_value", F.round(value, 9)).withColumn("_n", F.count(F.lit(1)).over(q))
    order = Window.partitionBy("query").orderBy(F.when(F.col("_n") <= top_k, 0.0).otherwise(-F.col("_value")), "rank")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("_file", "_value", "_n")


def mmr_greedy(pool: DataFrame, top_k: int, lambda_: float = 0.7) -> DataFrame:
    """The same choice step by step, for pools whose scores don't fall with the rank (after reranking).

    A pool is a few dozen rows; ``(query, doc, score, rank, source_ref)`` in and out.
    """

    def choose(rows):
        rows = rows.sort_values("rank").reset_index(drop=True)
        if len(rows) > top_k:
            lo, hi = rows["score"].min(), rows["score"].max()
            norm = [(s - lo) / (hi - lo) if hi > lo else 0.5 for s in rows["score"]]
            files = [(r or "").split("#")[0] or f"#{i}" for i, r in enumerate(rows["source_ref"])]
            taken, left = [0], list(range(1, len(rows)))
            while left and len(taken) < top_k:
                used = {files[i] for i in taken}
                best = max(left, key=lambda i: (lambda_ * norm[i] - (1 - lambda_) * (files[i] in used), -i))
                taken.append(best)
                left.remove(best)
            rows = rows.iloc[taken].reset_index(drop=True)
        rows["rank"] = range(1, len(rows) + 1)
        return rows

    columns = pool.select("query", "doc", "score", "rank", "source_ref")
    return columns.groupBy("query").applyInPandas(choose, columns.schema)


def session(pool: DataFrame, seen: DataFrame) -> DataFrame:
    """Ranks ``pool`` anew for a session: entries of ``seen(query, source_ref)`` sink, other parts of their files rise.

    Only positive scores change; equal ones keep their order.
    """
    seen = seen.where("source_ref is not null").distinct()
    refs = seen.select("query", "source_ref", F.lit(True).alias("_seen"))
    files = seen.select("query", file_of(F.col("source_ref")).alias("_file"), F.lit(True).alias("_near")).distinct()
    p = pool.withColumn("_file", file_of(F.col("source_ref"))).join(refs, ["query", "source_ref"], "left").join(files, ["query", "_file"], "left")
    new = F.when((F.col("score") > 0) & F.coalesce("_seen", F.lit(False)), F.col("score") * SEEN)
    new = new.when((F.col("score") > 0) & F.coalesce("_near", F.lit(False)) & (F.col("_file") != ""), F.col("score") * SIBLING).otherwise(F.col("score"))
    p = p.withColumn("score", F.round(new, 6)).drop("_seen", "_near", "_file")
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rank")))


def siblings(pool: DataFrame, shown: int, seen: DataFrame | None = None) -> DataFrame:
    """Up to four other sections of shown files, from the twelve results after the shown ones, with their ``place``."""
    rows = pool.withColumn("_file", file_of(F.col("source_ref")))
    rows = rows.withColumn("_near", F.min("rank").over(Window.partitionBy("query", "_file")) <= shown)
    rest = rows.where(F.col("_near") & (F.col("_file") != "") & (F.col("rank") > shown) & (F.col("rank") <= shown + SUGGEST_FROM) & F.contains("source_ref", F.lit("#")))
    if seen is not None:
        rest = rest.join(seen.select("query", "source_ref").distinct(), ["query", "source_ref"], "left_anti")
    rest = rest.withColumn("_k", F.row_number().over(Window.partitionBy("query", "source_ref").orderBy("rank"))).where("_k = 1")
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= SUGGEST_SIBLINGS).drop("_file", "_near", "_k")


def tag_suggestions(pool: DataFrame, shown: int, seen_tags: DataFrame | None = None) -> DataFrame:
    """The five most frequent tags among the twelve results after the shown ones that those don't have."""
    tags = pool.where(F.col("rank") <= shown + SUGGEST_FROM).select("query", "rank", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    n = tags.groupBy("query", "tag").agg(F.count_if(F.col("rank") > shown).alias("n"), F.count_if(F.col("rank") <= shown).alias("_had"))
    n = n.where((F.col("n") > 0) & (F.col("_had") == 0) & F.length("tag").between(3, 30) & ~F.col("tag").isin(*NOISE_TAGS)).drop("_had")
    if seen_tags is not None:
        n = n.join(seen_tags.select("query", "tag").distinct(), ["query", "tag"], "left_anti")
    return n.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= SUGGEST_TAGS)


def reranked(pool: DataFrame, scorer: str, top_k: int) -> DataFrame:
    """The best ``top_k`` ordered by the column ``scorer``, which becomes their score; the tail as it was."""
    head = F.col("rank") <= top_k
    order = Window.partitionBy("query").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col(scorer)).otherwise(0.0), "rank")
    return pool.withColumn("_new", F.row_number().over(order)).withColumn("score", F.when(head, F.col(scorer)).otherwise(F.col("score"))).withColumn("rank", F.col("_new")).drop("_new")


def rerank_with(pool: DataFrame, score_pairs, top_k: int) -> DataFrame:
    """``reranked`` by a pandas function ``score_pairs(query_texts, texts) -> scores``; on its failure the pool stays.

    ``pool`` has ``query_text`` and ``text``.  Only the pool's head is scored, and checked at once, so that a
    failing model is noticed here.
    """
    import warnings

    from pyspark.sql.functions import pandas_udf

    if pool.groupBy("query").count().where("count > 1").isEmpty():
        return pool
    scorer = pandas_udf(score_pairs, "double")
    try:
        head = pool.where(F.col("rank") <= top_k).select("query", "doc", scorer("query_text", "text").alias("_ce")).persist()
        head.count()
    except Exception as failed:  # any scorer may be plugged in
        warnings.warn(f"reranker failed, ranking kept: {failed}", stacklevel=2)
        return pool
    return reranked(pool.join(head, ["query", "doc"], "left"), "_ce", top_k).drop("_ce")
