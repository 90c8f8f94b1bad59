"""Structured Streaming: change queues, last operation by path, incremental upserts and session windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loresift.operators import store
from loresift.sources.schemas import QUEUE


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """Changes ``(ts, path, op)`` as JSON files dropped into ``folder``."""
    return spark.readStream.schema(QUEUE).json(folder)


def apply_changes(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], load: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch's last operation on every path becomes upserts and deletions by ``path``.

    ``load`` turns ``(path)`` into new rows.  Repeating a batch changes nothing, so replays after a failure are safe.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = store.last_op(batch.withColumn("seq", F.struct("ts", F.monotonically_increasing_id()))).persist()
        gone = last.select("path")
        kept = read().join(gone, "path", "left_anti")
        write(kept.unionByName(load(last.where("op <> 'deleted'").select("path"))))
        last.unpersist()

    return run


def keep_last(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``(path, seq, op)`` that keeps the last operation on every path as a table in ``folder``.

    Batch ``n`` is written from the state that batch ``n - 1`` left, under its own number, so a restart goes on from there and
    a repeated batch gives the same state again.
    """

    def run(batch: DataFrame, n: int) -> None:
        now = batch.select("path", "seq", "op")
        if n:
            now = now.unionByName(batch.sparkSession.read.parquet(f"{folder}/v/n={n - 1}"))
        now.groupBy("path").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{folder}/v/n={n}")

    return run


def kept_last(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state that ``keep_last`` wrote."""
    rows = spark.read.option("basePath", f"{folder}/v").parquet(f"{folder}/v")
    last = rows.agg(F.max("n")).first()[0]
    return rows.where(F.col("n") == last).drop("n")


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies changes every so often, or once for all that is there."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def last_op_state(changes: DataFrame) -> DataFrame:
    """Across batches: the last operation on every path, whenever it changes; the latest ``ts`` counts, and of equal ones the later row."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ts, op = state.get if state.exists else ("", "")
        for p in parts:
            for t, o in zip(p["ts"], p["op"], strict=True):
                if t >= ts:
                    ts, op = t, o
        state.update((ts, op))
        yield pd.DataFrame({"path": [key[0]], "ts": [ts], "op": [op]})

    return changes.groupBy("path").applyInPandasWithState(step, "path string, ts string, op string", "ts string, op string", "update", "NoTimeout")


def session_windows(events: DataFrame, key: str, ts: str, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, start, last, n)`` of sessions that a gap of over ``idle`` ends; works on streams and tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def throttled(turns: DataFrame, every: int = 5) -> DataFrame:
    """Streaming turn counter ``(key, due)`` over ``turns(key, marker)``: due once ``every`` turns came since the last marker, or none ever did."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else every
        for p in parts:
            for marker in p["marker"]:
                n = 0 if marker else n + 1
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "due": [n >= every]})

    return turns.groupBy("key").applyInPandasWithState(step, "key string, due boolean", "n long", "update", "NoTimeout")
