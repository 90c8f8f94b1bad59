"""Vectors by content: a cache keyed by the text's hash, what it lacks, and whatever embedder the caller plugs in."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.operators.store import compacted, missing_vectors
from loresift.sources.jsonl import read_version, write_version

CACHE = "content_hash string, vec array<double>"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE)


def load(spark: SparkSession, folder: str, size: int | None = None) -> DataFrame:
    """The cache in ``folder``; empty if there is none, if it can't be read, or if its vectors differ in length (or from ``size``)."""
    try:
        cache = read_version(spark, folder).select("content_hash", F.col("vec").cast("array<double>").alias("vec"))
        lengths = [r["n"] for r in cache.select(F.size("vec").alias("n")).distinct().limit(2).collect()]
    except (PySparkException, TypeError):
        return empty(spark)
    return cache if len(lengths) == 1 and size in (None, lengths[0]) else empty(spark)


def save(cache: DataFrame, folder: str, active: DataFrame | None = None) -> str:
    """Writes a new version of the cache, of equal hashes one; with ``active(content_hash)`` only what is still in use."""
    kept = compacted(cache, active) if active is not None else cache
    return write_version(kept.dropDuplicates(["content_hash"]), folder)


def looked_up(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``texts`` with ``vec``, null where the cache lacks it; null texts have none."""
    keyed = texts.withColumn("content_hash", F.sha2("text", 256))
    return keyed.join(cache, "content_hash", "left").drop("content_hash")


def filled(texts: DataFrame, cache: DataFrame, embed: Callable) -> DataFrame | None:
    """The cache with the vectors of all ``texts(text)``; each missing text is embedded once.

    ``embed`` is a pandas function from a Series of texts to a Series of lists.  If it fails, that is warned about and
    there is no result: the caller keeps the ranking it has.
    """
    from pyspark.sql.functions import pandas_udf

    one = pandas_udf(embed, "array<double>")
    lacking = texts.where("text is not null").select("text").distinct().withColumn("content_hash", F.sha2("text", 256))
    lacking = lacking.join(missing_vectors(texts, cache), "content_hash", "left_semi")
    try:
        new = lacking.select("content_hash", one("text").alias("vec")).persist()
        new.count()
    except Exception as failed:  # any model may be plugged in
        warnings.warn(f"embedder failed, vectors left out: {failed}", stacklevel=2)
        return None
    return cache.select("content_hash", "vec").unionByName(new)


def for_search(docs: DataFrame, queries: DataFrame, cache: DataFrame, embed: Callable | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Vectors of ``docs(corpus, doc, text)`` and ``queries(corpus, query, text)`` for ``bm25.search``; none if some can't be had."""
    texts = docs.select("text").union(queries.select("text"))
    if embed is not None:
        cache = filled(texts, cache, embed)
        if cache is None:
            return None
    elif not missing_vectors(texts.where("text is not null"), cache).isEmpty():
        warnings.warn("texts without vectors and no embedder: the lexical ranking is kept", stacklevel=2)
        return None
    return looked_up(docs, cache).select("corpus", "doc", "vec"), looked_up(queries, cache).select("corpus", "query", F.col("vec").alias("qvec"))
