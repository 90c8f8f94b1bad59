"""Watching source trees: scan, compare, enqueue, apply; what was queued and not applied is applied at the next start.

A batch leaves the queue only once it is applied, so a crash in between repeats it, and applying is idempotent.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path
from threading import Event
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.operators import store
from loresift.sources import config, files
from loresift.sources.schemas import QUEUE

EVERY = 600.0


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mtime)`` of the watchable files below ``root``; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(at, F.lit(len(str(Path(root).resolve()).rstrip("/")) + 2), F.length(at))
    rows = raw.select(rel.alias("path"), F.unix_micros("modificationTime").alias("mtime"))
    return rows.where(files.watchable(F.col("path"), files.ignore_rules(root)))


def append(folder: str | Path, changes: Iterable[tuple[str, str]], now: str) -> None:
    """Drops ``(path, op)`` changes into the queue as one file, which appears at once."""
    rows = [json.dumps({"ts": now, "path": p, "op": op}) for p, op in changes]
    if rows:
        Path(folder).mkdir(parents=True, exist_ok=True)
        part = Path(folder) / f".{uuid.uuid4().hex}"
        part.write_text("\n".join(rows) + "\n", encoding="utf-8")
        os.replace(part, Path(folder) / f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json")


def pending(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, list[Path]]:
    """``(path, op)``: the last operation on every path of the queue, and the files it comes from."""
    found = sorted(Path(folder).glob("*.json")) if Path(folder).is_dir() else []
    if not found:
        return spark.createDataFrame([], "path string, op string"), []
    rows = spark.read.schema(QUEUE).json([str(p) for p in found]).where("path is not null and op is not null")
    return store.last_op(rows.withColumn("seq", F.struct("ts", F.input_file_name(), F.monotonically_increasing_id()))).select("path", "op"), found


def drain(spark: SparkSession, folder: str | Path, apply: Callable[[DataFrame], None]) -> int:
    """Applies what is queued, then removes it; the number of paths.  If ``apply`` fails the queue stays."""
    changes, taken = pending(spark, folder)
    if not taken:
        return 0
    n = changes.count()
    apply(changes)
    for p in taken:
        p.unlink(missing_ok=True)
    return n


class Watcher:
    """Polls the trees of a watch list; the list is read anew in every round, and one tree's failure doesn't stop the others.

    ``apply(root, changes)`` takes ``changes(path, op)`` of one tree.  State, queues and the heartbeat stay in ``folder``.
    """

    def __init__(self, spark: SparkSession, watchlist: str | Path, folder: str | Path, apply: Callable[[str, DataFrame], None]):
        self.spark, self.watchlist, self.folder, self.apply = spark, watchlist, Path(folder), apply
        self.folder.mkdir(parents=True, exist_ok=True)
        self.failed: dict[str, str] = {}
        self.stop = Event()

    def _own(self, root: str) -> Path:
        return self.folder / uuid.uuid5(uuid.NAMESPACE_URL, root).hex

    def _round(self, root: str) -> int:
        """Compares a tree with its last state, queues the differences and applies the queue."""
        own = self._own(root)
        now = {r["path"]: r["mtime"] for r in scan(self.spark, root).collect()}
        was = config.load_state(own.with_suffix(".state"))
        if was is not None:
            ops = [(p, "created") for p in now if p not in was] + [(p, "deleted") for p in was if p not in now] + [(p, "modified") for p in now if p in was and was[p] != now[p]]
            append(own, ops, datetime.now(UTC).isoformat(timespec="microseconds"))
        config.save_state(own.with_suffix(".state"), now)
        return drain(self.spark, own, lambda changes: self.apply(root, changes))

    def step(self) -> dict[str, int]:
        """One round over the list as it is now: the number of applied paths by tree."""
        done: dict[str, int] = {}
        for root in config.watchlist(self.watchlist):
            try:
                done[root] = self._round(root)
                self.failed.pop(root, None)
            except Exception as failed:  # a tree may be gone or unreadable; the next round tries again
                self.failed[root] = str(failed)[:500]
        self.beat(done)
        return done

    def beat(self, done: dict[str, int]) -> None:
        config.save_state(self.folder / "heartbeat.json", {"ts": datetime.now(UTC).isoformat(timespec="seconds"), "pid": os.getpid(), "applied": done, "failed": self.failed})

    def flush(self) -> int:
        """Applies whatever is queued, without a look at the trees."""
        n = 0
        for root in config.watchlist(self.watchlist):
            n += drain(self.spark, self._own(root), lambda changes, root=root: self.apply(root, changes))
        return n

    def run(self, every: float = EVERY, rounds: int | None = None) -> None:
        """Rounds until ``stop`` is set (or so many); queues left from before are applied first, and at the end."""
        self.flush()
        k = 0
        while not self.stop.is_set() and (rounds is None or k < rounds):
            self.step()
            k += 1
            if rounds is None or k < rounds:
                self.stop.wait(every)
        self.flush()


def heartbeat(folder: str | Path) -> dict[str, Any] | None:
    return config.load_state(Path(folder) / "heartbeat.json")
