"""BM25 over many corpora and queries at once, on the DataFrame API.

``docs(corpus, doc, pos, text)`` are scored for ``queries(corpus, query, text)``; statistics are those of the rows given, so
any filter that belongs to the semantics (tags, deletions) is applied to ``docs`` before.  All documents of a
corpus are ranked, those without a query word too: they have the score 0 and keep the order of ``pos``.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from loresift.functions import text as T
from loresift.operators import blocks


@dataclass(frozen=True)
class SearchParams:
    """All that a ranking depends on; a sweep is a loop over changed copies."""

    top_n: int = 10
    k1: float = 1.5
    b: float = 0.85
    eps: float = 0.25
    kind_boost: Mapping[str, float] = field(default_factory=lambda: {"rule": 4.0, "pattern": 1.5})
    source_boost: Mapping[str, float] = field(default_factory=lambda: {"manual": 1.0})
    ref_weight: int = 3
    basename_weight: int = 2
    title_weight: int = 2
    docs_weight: int = 1
    hybrid_alpha: float = 0.0
    rerank_top_k: int = 0
    mmr_lambda: float = 0.7
    mmr_enabled: bool = False
    mmr_pool: int = 20
    digits: int = 4

    def changed(self, **values) -> SearchParams:
        return replace(self, **values)


def tokenised(docs: DataFrame) -> DataFrame:
    """``(corpus, doc, dl, ws)``: the stemmed tokens of each document in order, and how many there are."""
    return docs.select("corpus", "doc", T.raw_tokens(F.col("text")).alias("ws")).select("corpus", "doc", F.size("ws").alias("dl"), F.transform("ws", T.stem).alias("ws"))


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(corpus, doc, term, tf, dl)``: how often each document has each token, and how many it has.

    With ``wanted(corpus, term)`` only those terms: others leave before anything is shuffled.
    """
    words = tokenised(docs).select("corpus", "doc", "dl", F.explode("ws").alias("term"))
    if wanted is not None:
        words = words.join(wanted.select("corpus", "term").distinct(), ["corpus", "term"], "left_semi")
    return words.groupBy("corpus", "doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(corpus, term, df)``; a document's distinct terms are found within its row, and tasks add up before the shuffle."""
    terms = tokenised(docs).select("corpus", F.explode(F.array_distinct("ws")).alias("term"))
    return terms.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``(corpus, n, avgdl)`` over all documents, those without tokens too."""
    size = docs.select("corpus", F.size(T.raw_tokens(F.col("text"))).alias("dl"))
    return size.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))


def term_stats(frequencies: DataFrame, stats: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``(corpus, term, df, idf)``; a negative idf becomes ``eps`` times the mean over the whole vocabulary."""
    df = frequencies.join(stats, "corpus")
    raw = df.withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("corpus").agg(F.avg("idf0").alias("mean_idf"))
    return raw.join(mean, "corpus").select("corpus", "term", "df", F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(p.eps * F.col("mean_idf")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(corpus, query, term, qtf)``: a repeated query word counts as often as it stands there."""
    return queries.select("corpus", "query", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("corpus", "query", "term").agg(F.count(F.lit(1)).alias("qtf"))


def hits(docs: DataFrame, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``(corpus, query, doc, qtf, idf, tf, dl, avgdl)``: all that scores are made of; independent of ``k1`` and ``b``."""
    stats = corpus_stats(docs)
    asked = query_terms(queries)
    terms = asked.join(term_stats(document_frequencies(docs), stats, p), ["corpus", "term"]).join(stats, "corpus")
    return postings(docs, asked).join(terms, ["corpus", "term"]).select("corpus", "query", "doc", "qtf", "idf", "tf", "dl", "avgdl")


def part(p: SearchParams):
    """What one row of ``hits`` adds to a score."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl")))


def matches(docs: DataFrame, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``(corpus, query, doc, score)`` of the documents that share a token with the query."""
    return hits(docs, queries, p).groupBy("corpus", "query", "doc").agg(F.sum(part(p)).alias("score"))


def ranked(docs: DataFrame, queries: DataFrame, scored: DataFrame, top_n: int, digits: int = 4, *keep: str) -> DataFrame:
    """The ``top_n`` documents of every query by rounded score, then ``pos``: ``(corpus, query, doc, pos, score, rank)``.

    Documents without a score count as 0.  The first ``2 * top_n`` of the corpus hold enough of them, unless a query has
    scores below 0, which is a matter of tiny corpora; for a query that then lacks candidates all documents are looked up.
    ``scored`` is evaluated once: what follows reads the exchange of ``found``.
    """
    place = docs.select("corpus", "doc", "pos", *keep)
    scored = scored.select("corpus", "query", "doc", (F.round("score", digits) + F.lit(0.0)).alias("score"))
    heads = place.withColumn("_k", F.row_number().over(Window.partitionBy("corpus").orderBy("pos"))).where(F.col("_k") <= 2 * top_n)
    asked = queries.select("corpus", "query").distinct()
    unscored = lambda rows, of: rows.select("corpus", "doc").join(of, "corpus").select("corpus", "query", "doc", F.lit(None).cast("double").alias("score"))
    found = scored.union(unscored(heads, asked)).groupBy("corpus", "query", "doc").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    sizes = found.groupBy("corpus", "query").agg(F.count_if(F.col("score") >= 0).alias("up"), F.count_if(F.col("score") < 0).alias("down"))
    short = sizes.where((F.col("up") < top_n) & (F.col("down") > 0)).select("corpus", "query")
    rest = unscored(place, short).na.fill(0.0, ["score"]).join(found.select("corpus", "query", "doc"), ["corpus", "query", "doc"], "left_anti")
    first = Window.partitionBy("corpus", "query").orderBy(F.desc("score"), "pos")
    columns = ["corpus", "query", "doc", "pos", "score", *keep]
    best = found.union(rest.select("corpus", "query", "doc", "score")).join(place, ["corpus", "doc"]).select(*columns)
    return best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top_n)


def boosted(scored: DataFrame, docs: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """Positive scores times the boosts of the document's ``kind`` and ``source``; others unchanged."""

    def factor(column: str, table: Mapping[str, float]):
        out = None
        for name, value in table.items():
            out = F.when(F.col(column) == name, value) if out is None else out.when(F.col(column) == name, value)
        return F.lit(1.0) if out is None else F.coalesce(out, F.lit(1.0))

    both = scored.join(docs.select("corpus", "doc", "kind", "source"), ["corpus", "doc"])
    up = F.col("score") * factor("kind", p.kind_boost) * factor("source", p.source_boost)
    return both.select("corpus", "query", "doc", F.when(F.col("score") > 0, up).otherwise(F.col("score")).alias("score"))


def field_text(text, ref, p: SearchParams = SearchParams()):
    """The searchable text of an entry: its text, and reference, base name, title and docs as often as they weigh."""
    from loresift.functions.refs import basename

    base = basename(ref)
    title = F.regexp_extract(text, 'Markdown doc — "([^"]+)"', 1)
    docs = F.regexp_extract(text, "(?s)\\nDocs: (.+)$", 1)
    many = lambda c, k: [c] * k
    none = F.lit(None).cast("string")
    has_ref = F.coalesce(ref, F.lit("")) != ""
    return F.concat_ws(
        " ",
        text,
        *many(F.when(has_ref, ref).otherwise(none), p.ref_weight),
        *many(F.when(has_ref & (base != "") & (F.lower(base) != "readme"), base).otherwise(none), p.basename_weight),
        *many(F.when(title != "", title).otherwise(none), p.title_weight),
        *many(F.when(docs != "", docs).otherwise(none), p.docs_weight),
    )


def search(docs: DataFrame, queries: DataFrame, p: SearchParams = SearchParams(), vectors: tuple[DataFrame, DataFrame] | None = None, reranker=None) -> DataFrame:
    """``(corpus, query, doc, pos, score, rank)``: boost, fusion, reranking and diversification in this order, as ``p`` asks.

    Boosts need ``kind`` and ``source`` in ``docs``; fusion (``hybrid_alpha`` > 0) needs ``vectors``, those of documents
    ``(corpus, doc, vec)`` and of queries ``(corpus, query, qvec)``, or is warned about and left out; ``rerank_top_k`` needs a
    ``reranker`` (see ``rank.rerank_with``) and ``mmr_enabled`` a ``source_ref``.  Reranking and diversification read ``query`` alone, so
    that queries have numbers of their own across corpora.
    """
    from loresift.operators import rank

    scored = matches(docs, queries, p)
    if {"kind", "source"} <= set(docs.columns):
        scored = boosted(scored, docs, p)
    pool = max(p.top_n, p.rerank_top_k if reranker is not None else 0, max(2 * p.top_n, p.mmr_pool) if p.mmr_enabled else 0)
    if p.hybrid_alpha > 0 and vectors is None:
        warnings.warn("no vectors for a fused search: the lexical ranking is kept", stacklevel=2)
    if p.hybrid_alpha > 0 and vectors is not None:
        dv = docs.select("corpus", "doc", "pos").join(vectors[0], ["corpus", "doc"])
        found = rank.fused(dv, vectors[1], scored, p.hybrid_alpha, pool, p.digits)
    else:
        found = ranked(docs, queries, scored, pool, p.digits)
    if p.rerank_top_k > 0 and reranker is not None:
        texts = queries.select("corpus", "query", F.col("text").alias("query_text"))
        found = rank.rerank_with(found.join(docs.select("corpus", "doc", "text"), ["corpus", "doc"]).join(texts, ["corpus", "query"]), reranker, p.rerank_top_k).drop("text", "query_text")
    if p.mmr_enabled and "source_ref" in docs.columns:
        by_score = p.rerank_top_k <= 0 or reranker is None
        refs = found.join(docs.select("corpus", "doc", "source_ref"), ["corpus", "doc"])
        if by_score:
            found = rank.mmr(refs, p.top_n, p.mmr_lambda).drop("source_ref")
        else:
            chosen = rank.mmr_greedy(refs, p.top_n, p.mmr_lambda).select("query", "doc", "rank")
            found = found.drop("rank").join(chosen, ["query", "doc"])
    return found.where(F.col("rank") <= p.top_n).select("corpus", "query", "doc", "pos", "score", "rank")


#: Documents and queries of a corpus that one task scores at once.
DOC_BLOCK, MANY = 1 << 12, 1 << 14


def search_many(docs: DataFrame, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``search`` by the words alone, for as many queries as documents: ``(corpus, query, doc, pos, score, rank)``.

    Every document meets every query of its corpus in blocks of ``DOC_BLOCK`` documents and ``MANY`` queries, which hold the
    documents' tokens and the queries' weighted terms; scores stay in the task, and only each block's best are shuffled.
    """
    blocks.small_batches(docs.sparkSession)
    stats, asked = corpus_stats(docs), query_terms(queries)
    terms = asked.join(term_stats(document_frequencies(docs), stats, p), ["corpus", "term"])
    terms = terms.groupBy("corpus", "query").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("ts"))
    every = queries.select("corpus", "query").distinct()
    none = lambda c: F.array().cast(f"array<{c}>")
    weighted = every.join(terms, ["corpus", "query"], "left").select("corpus", "query", F.coalesce("ts.term", none("string")).alias("terms"), F.coalesce("ts.w", none("double")).alias("weights"))
    many = lambda c, block: F.ceil(F.col(c) / block).cast("int")
    sizes = every.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_q")).join(stats, "corpus").select("corpus", "avgdl", many("n", DOC_BLOCK).alias("d_blocks"), many("n_q", MANY).alias("q_blocks"))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    tokens = docs.select("corpus", "doc", F.col("pos").cast("long").alias("pos"), T.tokens(F.col("text")).alias("ws"))
    left = tokens.join(sizes, "corpus").select("corpus", "doc", "pos", "ws", "avgdl", one_of("doc", "d_blocks").alias("_d"), all_of("q_blocks").alias("_q"))
    right = weighted.join(sizes, "corpus").select(F.col("corpus").alias("_c"), F.col("query").alias("query"), "terms", "weights", one_of("query", "q_blocks").alias("_q"), all_of("d_blocks").alias("_d"))
    schema = StructType([left.schema["corpus"], right.schema["query"], left.schema["doc"], left.schema["pos"], StructField("score", DoubleType())])
    best = left.groupBy("corpus", "_d", "_q").cogroup(right.groupBy("_c", "_d", "_q")).applyInArrow(blocks.many_of(p, to_arrow_schema(schema)), schema)
    first = Window.partitionBy("corpus", "query").orderBy(F.desc("score"), "pos")
    return best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.top_n)
