"""Benchmark decontamination by spaced-seed hashing (operator 1).

Fixed masks keep some positions of a token window and ignore the others, so a hash of the kept tokens still
matches where ignored ones were substituted.  The hashes of all benchmark windows are joined with those
of all document windows; around every hit the two are laid side by side and the longest stretch that
agrees in a share of ``similarity`` of its tokens is the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import need, session, small_batches
from loresift.llm.wordhash import PLAIN, hashed

#: Kept (1) and ignored (0) positions; five tokens each, as shingles have elsewhere.
MASKS = ("11111", "1101011", "110010011", "1010011001", "10100100101")
#: For items under the least overlap: what stands between their substitutions always has three tokens in a row.
SHORT_MASK = "111"
#: Benchmark tokens held by a worker at once; larger benchmarks are taken in blocks of this size (an item is never cut).
BLOCK_TOKENS = 400_000
#: Pairs of equal seeds that are laid out at once.
PAIRS = 1 << 21
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_aligned long, n_matched long, item_tokens long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes of every full window of ``mask`` in the token hashes ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1":
            out = (out ^ h[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


class Index:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], least: int = 13):
        self.ids = np.array([i for i, _ in items], np.int64)
        arr = pa.array([t for _, t in items], pa.string())
        parts, off = [], [0]
        for _, _, h, o in hashed(arr, PLAIN):
            parts.append(h)
            off += (o[1:] + off[-1]).tolist()
        self.h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.off = np.array(off, np.int64)
        self.masks = []
        for k, mask in enumerate((*MASKS, SHORT_MASK)):
            value, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(len(self.ids)):
                if mask == SHORT_MASK and not 5 <= self.off[i + 1] - self.off[i] < least:
                    continue
                s = seeds(self.h[self.off[i] : self.off[i + 1]], mask, k)
                value.append(s)
                item.append(np.full(len(s), i))
                at.append(np.arange(len(s)))
            value, item, at = (np.concatenate(x) for x in (value, item, at))
            order = np.argsort(value, kind="stable")
            value = value[order]
            quick = np.zeros(1 << 20, bool)
            quick[(value >> np.uint64(44)).astype(np.int64)] = True
            self.masks.append((mask, value, item[order], at[order], quick))

    def hits(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) of all seed hits in the rows ``h[off[r]:off[r+1]]``, in that order.

        Pairs are laid out ``PAIRS`` at a time.  Where a row and an item have more of them than there are diagonals (the same
        words over and over), all diagonals are taken without a look at the pairs.
        """
        found: list[list[np.ndarray]] = [[], [], [], []]
        for k, (mask, value, _, _, quick) in enumerate(self.masks):
            s = seeds(h, mask, k)
            if not len(s) or not len(value):
                continue
            pos = np.flatnonzero(quick[(s >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(value, s[pos], "left"), np.searchsorted(value, s[pos], "right")
            row = np.searchsorted(off, pos, "right") - 1
            good = (hi > lo) & (pos + len(mask) <= off[row + 1])
            for part, x in zip(found, (row[good], np.full(int(good.sum()), k), pos[good] - off[row[good]], lo[good]), strict=True):
                part.append(x)
        if not found[0]:
            return np.empty((0, 3), np.int64)
        row, which, pos, lo = (np.concatenate(x) for x in found)
        out = []
        order = np.argsort(row, kind="stable")
        row, which, pos, lo = row[order], which[order], pos[order], lo[order]
        for r in np.unique(row).tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            length = int(off[r + 1] - off[r])
            for item, diagonals in self._diagonals(which[a:b], pos[a:b], lo[a:b], length):
                out.append(np.stack([np.full(len(diagonals), r), np.full(len(diagonals), item), diagonals], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)

    def _diagonals(self, which: np.ndarray, pos: np.ndarray, lo: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, its diagonals) of one row, whose hits are at ``pos`` with the mask ``which`` and the seed's first entry ``lo``."""
        pairs = np.zeros(len(self.ids))
        seen = []
        for k in np.unique(which).tolist():
            _, value, item, at, _ = self.masks[k]
            mine = which == k
            order = np.argsort(lo[mine], kind="stable")
            first, places = lo[mine][order], pos[mine][order]
            starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            times = np.diff(np.append(starts, len(first)))
            begin = first[starts]
            n = np.searchsorted(value, value[begin], "right") - begin
            entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            group = np.repeat(np.arange(len(starts)), n)
            pairs += np.bincount(item[entry], weights=times[group], minlength=len(pairs))
            seen.append((item[entry], at[entry], starts[group], times[group], places))
        sizes = np.diff(self.off)
        full = pairs > length + sizes
        for i in np.flatnonzero(full).tolist():
            yield i, np.arange(1 - int(sizes[i]), length)
        span = length + int(sizes.max()) + 1
        keys = np.empty(0, np.int64)
        for item, at, start, times, places in seen:
            some = np.flatnonzero(~full[item])
            ends = np.cumsum(times[some])
            lo_at = 0
            while lo_at < len(some):
                hi_at = max(lo_at + 1, int(np.searchsorted(ends, (ends[lo_at - 1] if lo_at else 0) + PAIRS, "right")))
                e = some[lo_at:hi_at]
                t = times[e]
                place = places[np.repeat(start[e] - np.cumsum(t) + t, t) + np.arange(t.sum())]
                keys = np.union1d(keys, np.repeat(item[e], t) * (2 * span) + place - np.repeat(at[e], t) + span)
                lo_at = hi_at
        item, diagonal = keys // (2 * span), keys % (2 * span) - span
        cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.empty(0, int)
        for a, b in zip(cuts, np.append(cuts[1:], len(item)), strict=False):
            yield int(item[a]), diagonal[a:b]


def longest_overlap(same: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """The longest stretch [a, b) that starts and ends in agreement and agrees in at least num/den of its tokens; of equal ones the first.

    A start counts only if no earlier one has as low a running score, so every end finds its best start by bisection.
    """
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0
    score = np.concatenate(([0], np.cumsum(np.where(same, den - num, -num))))
    low = score[starts]
    lowest = np.minimum.accumulate(low)
    new = np.concatenate(([True], low[1:] < lowest[:-1]))
    starts_kept, low = starts[new], low[new]
    begin = starts_kept[np.searchsorted(-low, -score[starts + 1], "left")]
    k = int(np.argmax(starts + 1 - begin))
    return int(begin[k]), int(starts[k]) + 1


def overlaps(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, least: int = 13) -> DataFrame:
    """The best verified overlap of every document and benchmark item that have one.

    An overlap has at least ``least`` tokens (or the whole item, if that is shorter but has five) of which
    ``num / den`` agree at the same distance.  Tokens are runs of letters and digits, A-Z lower-cased.  Positions are
    token positions.  Null or empty texts and null ids have no overlaps; repeated rows give repeated
    results; an empty table on either side gives an empty result; texts and items of any length are compared
    whole, in memory that grows with their lengths only.  Ties go to the first diagonal.
    """
    spark = session(docs)
    small_batches(spark)
    docs = need(docs, ["doc_id", "text"]).where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = need(benchmark, ["item_id", "text"]).where("item_id is not null and text is not null").dropDuplicates()
    out, block, size = None, [], 0

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(block, least))  # bounded by BLOCK_TOKENS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                ids = np.asarray(b.column(0))
                rows: dict[tuple[int, int], tuple] = {}
                for lo, _, h, off in hashed(b.column(1), PLAIN):
                    for r, i, d in index.hits(h, off).tolist():
                        item = index.h[index.off[i] : index.off[i + 1]]
                        doc = h[off[r] : off[r + 1]]
                        a, z = max(0, -d), min(len(item), len(doc) - d)
                        same = item[a:z] == doc[a + d : z + d]
                        was = rows.get((lo + r, i))
                        if int(same.sum()) <= (was[5] if was else 3):
                            continue  # it can't be the best, nor long enough
                        s, e = longest_overlap(same, num, den)
                        if e - s < min(least, len(item)) or e - s < 5:
                            continue
                        got = (int(ids[lo + r]), int(index.ids[i]), a + s + d, a + s, e - s, int(same[s:e].sum()), len(item))
                        if was is None or got[5] > was[5]:
                            rows[lo + r, i] = got
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows.values(), strict=True)], _NAMES)

        return docs.mapInArrow(run, SCHEMA)

    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].split()) + 1
        if size >= BLOCK_TOKENS:
            out = search(block) if out is None else out.union(search(block))
            block, size = [], 0
    if block or out is None:
        out = search(block) if out is None else out.union(search(block))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without any overlap; rows with a null id stay."""
    hit = overlaps(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
