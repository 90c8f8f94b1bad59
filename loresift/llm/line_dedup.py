"""Line deduplication by pairwise alignment (operator 6).

Lines are hashed.  What two documents can lose to each other is a run of neighbouring lines that has the words to be
deleted, so documents are paired by runs: the shortest ones that begin and that end at each line, each with its first
holder.  A pair is aligned by patience diff on its line hashes, repeated lines by longest common runs, and the aligned common
blocks are deleted from the later document.  A run that is left then, as it stands in another order or more often than in
its first holder, goes on by itself to the next holder, with which it is in line; if there is none before the
document, it stays.  No count of holders is capped, and a hot line costs one pair for each document.
Only hashes travel; texts are read once more, to cut them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import cut, need, session, small_batches
from loresift.llm.wordhash import hashed, mix

#: Words of an aligned block at least, to be deleted.
LEAST_WORDS = 5


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and words of every line of every text, and the offsets of each text's lines.

    Lines end at ``\\n``; they are equal if their words are.  A line without words has the hash 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lines = [(t or "").split("\n") for t in texts.to_pylist()]
    flat = pa.array([x for t in lines for x in t], pa.large_string())
    out, size = [], []
    for _, _, h, off in hashed(flat):
        n = np.diff(off)
        at = np.arange(len(h), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(at + np.uint64(0x9E3779B97F4A7C15))))))
        each = mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64))
        out.append(np.where(n > 0, each, np.uint64(0)))
        size.append(n)
    off = np.concatenate(([0], np.cumsum([len(t) for t in lines], dtype=np.int64)))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), (np.concatenate(size) if size else np.empty(0, np.int64)), off


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines of two hash sequences, in order in both; empty lines (0) only inside of blocks.

    Lines that occur once in either are matched and the longest increasing run of matches is kept; between two
    of its matches the rest is aligned the same way, and matches grow over equal neighbours.  Where only repeated lines
    are common, the longest common run is matched instead.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        there: dict[int, int] = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        pairs = [(i, there[h]) for h, i in once.items() if i >= 0 and h and there.get(h, -1) >= 0]
        pairs.sort()
        tails: list[int] = []
        heads: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
                heads.append(k)
            else:
                tails[at], heads[at] = j, k
            back.append(heads[at - 1] if at else -1)
        k, chain = heads[-1] if heads else -1, []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        if not chain:
            if any(h and h in there for h in once):
                # an empty line can't begin a run: those of either side differ
                x = [h or (0, k) for k, h in enumerate(a[a0:a1])]
                i, j, n = SequenceMatcher(None, x, b[b0:b1], autojunk=False).find_longest_match()
                out += [(a0 + i + k, b0 + j + k) for k in range(n)]
                todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)]
            continue
        last = (a0, b0)
        for i, j in reversed(chain):
            todo.append((last[0], i, last[1], j))
            out.append((i, j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def blocks(matches: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Lines of the second sequence in runs of consecutive matches that have ``least`` words together."""
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(matches):
        if k and (i, j) != (matches[k - 1][0] + 1, matches[k - 1][1] + 1):
            if sum(words[x] for x in run) >= least:
                out += run
            run = []
        run.append(j)
    return out + (run if sum(words[x] for x in run) >= least else [])


def runs(at: list[int], h: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, first line, last line) of the shortest runs of neighbouring lines with ``least`` words that begin or end at a line.

    Every longer run is covered by those in it, and equal runs are cut alike in any document.
    """
    spans = set()
    for k in range(len(at)):
        for step in (1, -1):
            end, n = k, words[k]
            while n < least and 0 <= end + step < len(at) and at[end + step] == at[end] + step:
                end += step
                n += words[end]
            if n >= least:
                spans.add((min(k, end), max(k, end)))
    out = []
    for lo, hi in sorted(spans):
        key = h[lo] if lo == hi else int.from_bytes(blake2b(array("q", h[lo : hi + 1]).tobytes(), digest_size=8).digest(), "little", signed=True)
        out.append((key, at[lo], at[hi]))
    return out


def by_row(lines: list[dict]) -> list[list[dict]]:
    """The lines of each row; there is more than one only where rows share an id."""
    rows: dict[int, list[dict]] = {}
    for x in lines:
        rows.setdefault(x["row"], []).append(x)
    return list(rows.values())


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed_words, text)`` of every row of ``docs(doc_id, text)``.

    A line block that is aligned with one in a document of a lower id goes from the later one, if it
    has ``least_words`` words, whichever earlier document that is.  Rows with a null id keep their lines and nothing is aligned with them; null
    texts count as empty; of rows that share an id all lose the lines that any of them loses at that place;
    equal rows stay equal.  Documents without shared lines stay as they are.
    """
    spark = session(docs)
    small_batches(spark)
    docs = need(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n, off = line_hashes(b.column(1))
            ids = np.repeat(np.asarray(b.column(0)), np.diff(off))
            at = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
            keep = h != 0
            row = np.repeat(np.array([crc32(h[x:y].tobytes()) for x, y in zip(off[:-1], off[1:], strict=True)], np.int64), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(at[keep]), pa.array(h[keep].view(np.int64)), pa.array(n[keep]), pa.array(row[keep])], ["doc_id", "at", "h", "words", "row"])

    lines = docs.where("doc_id is not null").mapInArrow(read, "doc_id long, at long, h long, words long, row long")
    first = lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
    first = cut(first)  # so that AQE can split the join on a hot line
    shared = cut(lines.join(first, "h").select("doc_id", "at", "h", "words", "row"))
    # a document's shared lines, as positions and hashes: all that alignment needs, as other lines match nothing
    body = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", "h", "words", "row"))).alias("lines"))
    body = cut(body)

    def run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for d, own in zip(b.column("doc_id").to_pylist(), b.column("lines").to_pylist(), strict=True):
                for mine in by_row(own):
                    keys = runs([p["at"] for p in mine], [p["h"] for p in mine], [p["words"] for p in mine], least_words)
                    ids += [d] * len(keys)
                    found += keys
            key, lo, hi = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, key, lo, hi)], ["doc_id", "key", "lo", "hi"])

    held = cut(body.mapInArrow(run_keys, "doc_id long, key long, lo long, hi long"))
    begun = cut(held.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"))
    held = cut(held.join(begun, "key").select("doc_id", "key", "lo", "hi", "first"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, gone = [], []
            for d, own, other in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), b.column("other").to_pylist(), strict=True):
                for mine, theirs in product(by_row(own), by_row(other)):
                    at = [p["at"] for p in mine]
                    matches = patience([p["h"] for p in theirs], [p["h"] for p in mine])
                    # neighbours among shared lines are a block only if they are neighbours in the texts
                    spread = [(theirs[i]["at"], at[j]) for i, j in matches]
                    words = {at[j]: mine[j]["words"] for _, j in matches}
                    for line in blocks(spread, words, least_words):
                        ids.append(d)
                        gone.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "at"])

    later = held.where("first < doc_id")
    pairs = later.select("doc_id", "first").distinct()
    both = pairs.join(body.select("doc_id", F.col("lines").alias("own")), "doc_id").join(body.select(F.col("doc_id").alias("first"), F.col("lines").alias("other")), "first")
    gone = cut(both.mapInArrow(align, "doc_id long, at long").distinct())
    # a run of which a line is left is aligned by itself with the next holder, which it always fits, so that is enough of them
    lost = gone.groupBy("doc_id").agg(F.collect_set("at").alias("lost"))
    left = later.join(lost.hint("merge"), "doc_id", "left").where(F.col("lost").isNull() | F.exists(F.sequence("lo", "hi"), lambda x: ~F.array_contains("lost", x)))
    left = cut(left.select("doc_id", "key", "lo", "hi"))
    second = cut(later.join(left.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("second")))
    more = left.join(second, "key").where("second < doc_id").select("doc_id", F.explode(F.sequence("lo", "hi")).alias("at"))
    gone = gone.union(more).groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    joined = docs.join(gone.hint("merge"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, "\n", -1)
    kept = F.filter(F.col("ls"), lambda _, i: ~F.array_contains(F.col("gone"), i.cast("long")))
    out = joined.withColumn("ls", split).withColumn("kept", F.when(F.col("gone").isNull(), F.col("ls")).otherwise(kept))
    words = lambda c: F.regexp_count(F.array_join(c, "\n"), F.lit("[^\\x20\\x09-\\x0D]+"))
    return out.select(
        "doc_id",
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), 0).otherwise(words(F.col("ls")) - words(F.col("kept"))).cast("long").alias("removed_words"),
        F.array_join("kept", "\n").alias("text"),
    )
