"""Conversational benchmark: every question ranks the sessions of its own corpus, all of them in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loresift.functions import text as T
from loresift.operators import blocks, evaluate
from loresift.operators.bm25 import SearchParams
from loresift.sources.jsonl import own_sessions

KS = (3, 5, 8, 10, 20)


def ranked(questions: DataFrame, p: SearchParams) -> DataFrame:
    """``(query, question_type, answer_session_ids, items)``: the names of each question's best ``top_n`` own sessions, in order.

    The ranking is that of ``bm25.search`` over ``question_corpus``.  A corpus of its own for each question needs nothing
    from other rows, so it is ranked within its row: no words are shuffled.
    """
    blocks.small_batches(questions.sparkSession)
    s = own_sessions(questions)
    rows = s.select(F.col("question_id").alias("query"), "question_type", "answer_session_ids", T.tokens(F.col("question")).alias("asked"), F.transform("texts", T.tokens).alias("texts"), "ids")
    keep = ["query", "question_type", "answer_session_ids"]
    return rows.mapInArrow(blocks.own_of(p, keep), StructType([*[rows.schema[c] for c in keep], StructField("items", rows.schema["ids"].dataType)]))


def judge(questions: DataFrame, ks: Sequence[int] = KS, p: SearchParams = SearchParams()) -> DataFrame:
    """``(query, question_type, k, recall, hit, ndcg, rr)`` of every question and cut-off.

    Questions without gold score 0 everywhere; a session that stands in a corpus twice counts at its better rank.
    """
    own = ranked(questions, p.changed(top_n=max(ks))).persist()  # a few names for each question
    found = own.select("query", F.posexplode("items").alias("rank", "item")).withColumn("rank", F.col("rank") + 1)
    gold = own.select("query", F.explode("answer_session_ids").alias("item"))
    firsts = evaluate.found(found, gold)
    rows = own.select("query", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k"))
    rows = rows.join(evaluate.judged(firsts, ks).select("query", "k", "recall", "hit"), ["query", "k"], "left").join(evaluate.ndcg(firsts, ks), ["query", "k"], "left").join(evaluate.reciprocal_rank(firsts), "query", "left")
    return rows.select("query", "question_type", "k", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall", "ndcg", "rr")], F.coalesce("hit", F.lit(0)).alias("hit"))


def summary(judged: DataFrame, *by: str) -> DataFrame:
    """Mean strict recall, any-recall, NDCG and reciprocal rank by cut-off, and by type or whatever else is named."""
    means = {"recall_strict": "recall", "recall_any": "hit", "ndcg": "ndcg", "mrr": "rr"}
    return judged.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in means.items()]).orderBy(*[F.desc("n"), *by, "k"])


def wide(judged: DataFrame) -> DataFrame:
    """One row for each question, cut-offs as columns: the shape of a report file."""
    return judged.groupBy("query", "question_type").pivot("k").agg(F.first("recall").alias("recall"), F.first("hit").alias("any"), F.first("ndcg").alias("ndcg"))
