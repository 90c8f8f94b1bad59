"""Regression runs of a question set: constraints on what is retrieved, and drift against a recorded ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.operators import store

CHANGES = ("dropped", "added", "reordered", "score_changed")


def checked(fixture: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """``(qid, place, met)``: whether each constraint of ``fixture(qid, top_n, must_match)`` holds for one of the best ``top_n`` entries.

    ``results(qid, id, rank)``; a question without results meets nothing.
    """
    wanted = fixture.select("qid", "top_n", F.posexplode("must_match").alias("place", "wanted"))
    e = entries.select("id", "text", "kind", "source_ref", "tags")
    rows = wanted.join(results.select("qid", "id", "rank"), "qid", "left").join(e, "id", "left")
    holds = store.constraint_holds({c: F.col(c) for c in e.columns}, F.col("wanted"))
    met = F.max((F.coalesce(holds & F.col("id").isNotNull(), F.lit(False)) & (F.col("rank") <= F.col("top_n"))).cast("int"))
    return rows.groupBy("qid", "place").agg((F.coalesce(met, F.lit(0)) == 1).alias("met"))


def passed(fixture: DataFrame, checks: DataFrame) -> DataFrame:
    """``(qid, passed, missing)``; a question without constraints passes, ``missing`` are the places of those not met."""
    per = checks.groupBy("qid").agg(F.min(F.col("met").cast("int")).alias("all"), F.sort_array(F.collect_list(F.when(~F.col("met"), F.col("place")))).alias("missing"))
    none = F.array().cast("array<int>")
    return fixture.select("qid").join(per, "qid", "left").select("qid", (F.coalesce("all", F.lit(1)) == 1).alias("passed"), F.coalesce("missing", none).alias("missing"))


def questions(fixture: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``(question, state)``: kept, new (not in the snapshot) or gone (not in the fixture)."""
    here = fixture.select("question").distinct().withColumn("here", F.lit(True))
    there = snapshot.select("question").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "gone").otherwise("kept")
    return here.join(there, "question", "full_outer").select("question", state.alias("state"))


def drift(old: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(question, dropped, added, reordered, score_changed, drifted)`` of the questions that both rankings have.

    Rankings are ``(question, id, rank, score)``; a changed score alone is no drift.
    """
    side = lambda df: df.select(F.col("question").alias("query"), "id", "rank", "score")
    both = old.select("question").distinct().join(new.select("question").distinct(), "question")
    changes = store.snapshot_diff(side(old), side(new), tolerance).withColumnRenamed("query", "question")
    per = changes.groupBy("question").agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
    out = both.join(per, "question", "left").na.fill(0, list(CHANGES))
    return out.withColumn("drifted", F.col("dropped") + F.col("added") + F.col("reordered") > 0)


def drift_counts(per_question: DataFrame) -> DataFrame:
    """One row: questions, those that drifted, and the changes of each kind."""
    return per_question.agg(F.count(F.lit(1)).alias("questions"), F.count_if("drifted").alias("drifted"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CHANGES])
