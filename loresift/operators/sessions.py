"""Operators over ordered events: windows of following calls, sessions, markers and what was seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_window(events: DataFrame, n: int) -> DataFrame:
    """``events(run, seq, event_id, is_query, file)``: for every query the files touched in the next ``n`` calls of its run.

    Queries count as calls; queries without any file in reach are left out.
    """
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(1, n)
    return events.withColumn("gold", F.array_sort(F.collect_set("file").over(w))).where("is_query and size(gold) > 0").select("run", "event_id", "gold")


def first_queries(events: DataFrame, least: int = 0) -> DataFrame:
    """The first of equal queries of a run, and only then those of at least ``least`` characters."""
    k = F.row_number().over(Window.partitionBy("run", "query").orderBy("seq"))
    return events.withColumn("_k", k).where("_k = 1").where(F.length("query") >= least).drop("_k")


def sessions(events: DataFrame, key: str, ts: str, idle: str = "30 minutes", *tie: str) -> DataFrame:
    """Events with the number of their session: a gap of more than ``idle`` starts a new one."""
    w = Window.partitionBy(key).orderBy(ts, *tie)
    gap = F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {idle}")
    return events.withColumn("session", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def turns_since(events: DataFrame, key: str, order: list[str], marker: Column, turn: Column, default: int = 5) -> DataFrame:
    """``(key, turns)``: turns after the last marker; without a marker ``default``."""
    place = F.struct(*order)
    last = events.groupBy(key).agg(F.max(F.when(marker, place)).alias("_last"))
    both = events.select(key, place.alias("_at"), turn.alias("_turn")).join(last, key)
    n = F.count_if(F.col("_turn") & (F.col("_at") > F.col("_last")))
    return both.groupBy(key).agg(F.when(F.max("_last").isNull(), F.lit(default).cast("long")).otherwise(n).alias("turns"))


def seen_before(events: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Events with how many distinct items came before in their group, and whether this one did."""
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(*order)) == 1
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_first", first)
    return e.withColumn("n_seen", F.coalesce(F.sum(F.col("_first").cast("long")).over(w), F.lit(0))).withColumn("again", ~F.col("_first")).drop("_first")


def seen_lists(events: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Events with ``seen``: the distinct items that came before in their group, in the order they first came."""
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(*order)) == 1
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_new", F.when(first, F.col(item))).withColumn("seen", F.collect_list("_new").over(w)).drop("_new")


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the last result of their id, if there is any."""
    last = results.groupBy("tool_use_id").agg(F.max_by("content", "seq").alias("result"))
    return calls.join(last, calls["id"] == last["tool_use_id"], "left").drop("tool_use_id")
