"""Lenient JSON-lines sources and sinks: entries, event logs, session logs, benchmark questions and evaluation pairs."""

from __future__ import annotations

import json
import os
import secrets
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.functions.refs import CROCKFORD
from loresift.sources import schemas as S


def objects(lines: DataFrame, schema: T.StructType, *needed: str) -> DataFrame:
    """JSON objects of ``lines(value, ...)``; blank, broken and other lines go, and those without a needed key."""
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.where(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("_x"), *rest).where("_x is not null").select("_x.*", *rest)
    for name in needed:
        parsed = parsed.where(F.col(name).isNotNull())
    return parsed


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(value, pos)``: lines of one text file and their order; the file is read by one task, as its order asks."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")).select("value", F.col("pos").cast("long").alias("pos"))


def decoded(df: DataFrame) -> DataFrame:
    """Entries with defaults for what is missing or invalid."""
    pair = F.when(F.size("source_lines") == 2, F.col("source_lines"))
    return df.withColumns(
        {
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "source": F.coalesce("source", F.lit("manual")),
            "source_lines": pair,
            "kind": F.when(F.col("kind").isin(*S.KINDS), F.col("kind")).otherwise("fact"),
        }
    )


def read_entries(spark: SparkSession, path: str, deleted: bool = False) -> DataFrame:
    """The store in ``path``, with each entry's place; soft-deleted entries only if asked for."""
    e = decoded(objects(numbered(spark, path), S.ENTRY, "id", "ts", "text"))
    return e if deleted else e.where("deleted_at is null")


def encoded(entries: DataFrame) -> DataFrame:
    """``(value, pos)``: entries as JSON lines without unset fields; the usual kind is left out too."""
    fields = [F.when(F.col("kind") != "fact", F.col("kind")).alias("kind") if f.name == "kind" else F.col(f.name) for f in S.ENTRY.fields]
    return entries.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"), "pos")


def append_entries(entries: DataFrame, path: str) -> None:
    """Appends to a local store file; the bytes are on disk on return."""
    with open(path, "a", encoding="utf-8") as f:
        for r in encoded(entries).orderBy("pos").toLocalIterator():
            f.write(r["value"] + "\n")
        f.flush()
        os.fsync(f.fileno())


def rewrite_entries(entries: DataFrame, path: str) -> None:
    """Replaces a local store file at once: readers see the old or the new one."""
    part = f"{path}.{secrets.token_hex(4)}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        for r in encoded(entries).orderBy("pos").toLocalIterator():
            f.write(r["value"] + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_version(entries: DataFrame, folder: str) -> str:
    """Writes a store table as a new version and points ``CURRENT`` at it; nothing that is being read is overwritten."""
    version = f"v{time.time_ns()}"
    entries.write.parquet(f"{folder}/{version}")
    spark = entries.sparkSession
    spark.createDataFrame([Row(value=version)]).coalesce(1).write.mode("overwrite").text(f"{folder}/CURRENT")
    return version


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{spark.read.text(f'{folder}/CURRENT').first()['value']}")


def new_id() -> str:
    """A random identifier that sorts by time."""
    n = (time.time_ns() // 1_000_000) << 80 | secrets.randbits(80)
    return "".join(CROCKFORD[n >> s & 31] for s in range(125, -1, -5))


def create_entry(spark: SparkSession, text: str, tags: list[str] | None = None, source: str = "manual", kind: str = "fact", **more: object) -> DataFrame:
    """One new entry, with an identifier and the time of now."""
    row = {f.name: None for f in S.STORED.fields} | {"id": new_id(), "ts": datetime.now(UTC).isoformat(timespec="seconds"), "text": text, "tags": [t.lower() for t in tags or []], "source": source, "kind": kind if kind in S.KINDS else "fact", "pos": time.time_ns()} | more
    return spark.createDataFrame([tuple(row[f.name] for f in S.STORED.fields)], S.STORED)


def discovered(folder: str, runs: list[str] | None = None, days: float | None = None, now: float | None = None) -> list[str]:
    """Log files ``*.jsonl`` below ``folder`` by name: those of the named runs, or those changed in the last ``days``, or all."""
    found = sorted(p for p in Path(folder).rglob("*.jsonl") if p.is_file()) if Path(folder).is_dir() else []
    if runs is not None:
        return [str(p) for p in found if p.stem in set(runs)]
    least = 0.0 if days is None else (time.time() if now is None else now) - 86_400 * days
    return [str(p) for p in found if p.stat().st_mtime >= least]


def read_events(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """Event logs: one run for each file, events in order; ``since`` leaves out files that are older."""
    reader = spark.read
    reader = reader.option("modifiedAfter", since) if since else reader
    lines = reader.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.jsonl)?$", 1).alias("run_id"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "value"))
    return objects(lines, S.EVENT)


def session_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Nested session logs flattened to events: a start, then every tool call with the last result of its id."""
    lines = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.jsonl)?$", 1).alias("run_id"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rows = objects(lines, S.SESSION_LINE)
    parts = rows.select("run_id", "line", "cwd", "timestamp", F.posexplode("message.content").alias("part", "c"))
    calls = parts.where("c.type = 'tool_use'").select("run_id", "line", "part", "cwd", "timestamp", F.col("c.id").alias("id"), F.col("c.name").alias("tool_name"), F.col("c.input").alias("tool_input"))
    results = parts.where("c.type = 'tool_result'").groupBy("run_id", F.col("c.tool_use_id").alias("id")).agg(F.max_by(F.col("c.content"), F.struct("line", "part")).alias("result"))
    calls = calls.join(results, ["run_id", "id"], "left").withColumn("event", F.lit("tool_called"))
    start = rows.where("cwd is not null").groupBy("run_id").agg(F.min_by("cwd", "line").alias("cwd"), F.min_by("timestamp", "line").alias("timestamp")).withColumn("event", F.lit("run_started")).withColumns({"line": F.lit(-1), "part": F.lit(0)})
    both = calls.drop("id").unionByName(start, allowMissingColumns=True)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("line", "part")) - 1).drop("line", "part")


def run_cwd(events: DataFrame) -> DataFrame:
    """``(run_id, run_cwd)``: the folder of each run's first start."""
    return events.where("event = 'run_started'").groupBy("run_id").agg(F.min_by("cwd", "seq").alias("run_cwd"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Conversational benchmark questions, one JSON object a line."""
    return objects(spark.read.text(path), S.QUESTION, "question_id")


def _told(turns: Column) -> Column:
    """A session's whole turns in order, each after its role."""
    whole = F.filter(turns, lambda t: t["role"].isNotNull() & t["content"].isNotNull())
    return F.array_join(F.transform(whole, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def own_sessions(q: DataFrame) -> DataFrame:
    """``q`` with ``ids`` and ``texts``, the names and texts of the sessions that ``question_corpus`` makes documents of."""
    n = F.least(F.size("haystack_session_ids"), F.size("haystack_dates"), F.size("haystack_sessions"))
    z = F.when(n > 0, F.slice(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), F.lit(1), n))
    none = F.array().cast("array<string>")
    return q.withColumn("_z", z).withColumns({"ids": F.coalesce("_z.haystack_session_ids", none), "texts": F.coalesce(F.transform("_z.haystack_sessions", _told), none)}).drop("_z")


def question_corpus(q: DataFrame) -> DataFrame:
    """``(corpus, doc, pos, ref, session_id, text)``: every question's own sessions as documents.

    Parallel arrays are cut to the shortest; references number the positions, so that no name gives gold away.
    """
    n = F.least(F.size("haystack_session_ids"), F.size("haystack_dates"), F.size("haystack_sessions"))
    z = F.slice(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), F.lit(1), n)
    rows = q.where(n > 0).select("question_id", F.posexplode(z).alias("pos", "s"))
    ref = F.concat(F.lit("session/"), "question_id", F.lit("/s"), F.lpad(F.col("pos").cast("string"), 3, "0"))
    return rows.select(F.col("question_id").alias("corpus"), ref.alias("doc"), F.col("pos").cast("long").alias("pos"), F.col("s.haystack_session_ids").alias("session_id"), _told(F.col("s.haystack_sessions")).alias("text"))


def freeze_pairs(pairs: DataFrame, path: str) -> None:
    """Evaluation pairs with the time and their number, as one JSON document."""
    rows = [json.loads(r["j"]) for r in pairs.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"frozen_at": datetime.now(UTC).isoformat(timespec="seconds"), "n_pairs": len(rows), "pairs": rows}, f, indent=2, ensure_ascii=False)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True)
    inner = T.StructType([T.StructField("pairs", T.ArrayType(S.PAIR))])
    return doc.select(F.explode(F.from_json("value", inner)["pairs"]).alias("p")).select("p.*")


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report table as CSV with a header, or as JSON lines."""
    if kind == "csv":
        rows.coalesce(1).write.option("header", True).csv(path)
    else:
        rows.coalesce(1).write.json(path)
