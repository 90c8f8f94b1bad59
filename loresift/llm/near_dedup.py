"""Near-duplicate groups by SetSketch registers (operator 10).

1. Equal word sequences form classes; each goes on as one representative, its least id.
2. A set with more than ``1 - threshold`` of its shingles in no other class can't be linked with anything,
   so it is done.  Shingles are counted exactly, in shards of their hashes; a task sends no shingle on that it
   already sent for two classes, so a word pair of all documents stays small.
3. The others get SetSketch registers; equal bands of registers put them into buckets.  Sets of up to
   eight shingles also get exact buckets, which no pair at 0.8 or more can miss if one has under eight.
4. Every member of a bucket is compared with the bucket's least member: the joint likelihood of the
   registers estimates the Jaccard index, and those in reach are verified on their full sets.
5. Buckets that touch form a neighbourhood.  Where one still holds several components, blocks of its members are
   compared across components, by likelihood and full sets again.  Thus a hot group costs one
   comparison per member, and no pair is lost that shares any bucket.
6. Components of the verified links; copies take over their representative's.

With ``m`` = 256 registers in 42 bands of 6, a pair of larger sets at the threshold 0.8 misses every bucket with a
probability of 3e-6; ``slack`` below the threshold is over five deviations of the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm import setsketch
from loresift.llm.common import cut, discard, need, session, small_batches
from loresift.llm.graph import components
from loresift.llm.wordhash import hashed, mix, shingles

ROWS_PER_BAND = 6
#: Shingle hashes that one shard of the count holds.
SHARD = 3_000_000
#: Classes whose counts are added up at once.
RANGE = 20_000
#: Members of a block in step 5.
BLOCK = 512
#: Shingles of two classes or more that a task remembers.
SENT = 1 << 20
#: Largest set with exact buckets.
SMALL = 8


def _sets(batch_texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first row, end, shingles, offsets, two 64-bit hashes of the word sequences)."""
    for lo, hi, h, off in hashed(batch_texts):
        n = np.diff(off)
        at = np.arange(len(h), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            each = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(at * np.uint64(2) + np.uint64(salt))))))
            out.append(mix((each[off[1:]] - each[off[:-1]]) + n.astype(np.uint64)).view(np.int64))
        v, o = shingles(h, off, size)
        yield lo, hi, v, o, out[0], out[1]


def word_classes(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n_shingles, h1, h2)``: set size and word-sequence hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, o, h1, h2 in _sets(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(o), pa.int64()), pa.array(h1), pa.array(h2)], ["doc_id", "n_shingles", "h1", "h2"])

    return need(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def _lonely(docs: DataFrame, size: int, shards: int, ranges: int) -> DataFrame:
    """``(h1, h2, lonely)``: how many of a class's shingles no other class has.

    Of a shingle that several classes of a block have, two go on; a task that sent two doesn't send it again.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.empty(0, np.uint64)
        for b in batches:
            for _, _, v, o, h1, h2 in _sets(b.column(0), size):
                # one of each class within the block
                _, first = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
                keep = np.zeros(len(h1), bool)
                keep[first] = True
                n = np.diff(o)
                row = np.repeat(np.arange(len(n)), n)
                use = keep[row]
                v, row = v[use], row[use]
                if len(sent) and len(v):
                    fresh = sent[np.minimum(np.searchsorted(sent, v), len(sent) - 1)] != v
                    v, row = v[fresh], row[fresh]
                if not len(v):
                    continue
                order = np.argsort(v, kind="stable")
                v, row = v[order], row[order]
                again = np.concatenate(([False], v[1:] == v[:-1]))
                third = again & np.concatenate(([False], again[:-1]))
                if len(sent) < SENT:
                    sent = np.union1d(sent, v[again & ~third])
                v, row = v[~third], row[~third]
                shard = (v % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((row, shard))
                v, row, shard = v[order], row[order], shard[order]
                low = (v // np.uint64(shards)).astype(np.uint32)
                ends = np.searchsorted(shard, np.arange(shards + 1))
                full = np.flatnonzero(np.diff(ends))
                ids, rows = [], []
                head = np.stack([h1, h2], axis=1)
                for s in full:
                    r = row[ends[s] : ends[s + 1]]
                    d, c = np.unique(r, return_counts=True)
                    ids.append(head[d].tobytes())
                    rows.append(c.astype(np.uint32).tobytes() + low[ends[s] : ends[s + 1]].tobytes())
                if len(full):
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(ids, pa.binary()), pa.array(rows, pa.binary())], ["shard", "ids", "body"])

    def count(key: tuple, t: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in t.column("ids")]
        low, doc, at = [], [], 0
        for head, x in zip(ids, t.column("body"), strict=True):
            raw = np.frombuffer(x.as_buffer(), np.uint32)
            low.append(raw[len(head) :])
            doc.append(np.repeat(np.arange(at, at + len(head), dtype=np.int32), raw[: len(head)]))
            at += len(head)
        head, low, doc = np.concatenate(ids), np.concatenate(low), np.concatenate(doc)
        # classes are numbered by their whole hash
        by = np.lexsort((head[:, 1], head[:, 0]))
        tag = np.empty(len(head), np.uint64)
        tag[by] = np.cumsum(np.concatenate(([False], (head[by[1:]] != head[by[:-1]]).any(axis=1)))).astype(np.uint64)
        order = np.argsort((low.astype(np.uint64) << np.uint64(32)) | tag[doc])
        low, doc = low[order], doc[order]
        tags = tag[doc]
        new = np.concatenate(([True], low[1:] != low[:-1]))
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(low)) - 1
        alone = tags[start] == tags[end]  # sorted by tag: one tag only
        pick = alone[group] & np.concatenate(([True], (tags[1:] != tags[:-1]) | (low[1:] != low[:-1])))
        n = np.bincount(doc[pick], minlength=len(head))
        some = np.flatnonzero(n)
        # a class's rows of several blocks and shards meet in the class's own range
        parts = np.concatenate([head[some], n[some, None]], axis=1).astype(np.int64)
        where = parts[:, 0] % ranges
        order = np.argsort(where, kind="stable")
        parts, where = parts[order], where[order]
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.empty(0, int)
        last = np.append(first[1:], len(where))
        return pa.table({"range": pa.array(where[first], pa.int64()), "packed": pa.array([parts[i:j].tobytes() for i, j in zip(first, last, strict=False)], pa.binary())})

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in t.column("packed")])
        a = a[np.lexsort((a[:, 1], a[:, 0]))]
        new = np.flatnonzero(np.concatenate(([True], (a[1:, :2] != a[:-1, :2]).any(axis=1))))
        return pa.table({"h1": a[new, 0], "h2": a[new, 1], "lonely": np.add.reduceat(a[:, 2], new)})

    packed = need(docs, ["text"]).mapInArrow(pack, "shard long, ids binary, body binary")
    counted = packed.groupBy("shard").applyInArrow(count, "range long, packed binary")
    return counted.groupBy("range").applyInArrow(add_up, "h1 long, h2 long, lonely long")


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, h1, h2, n, members, regs)``: the sorted shingle hashes and SetSketch registers, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, v, o, h1, h2 in _sets(b.column(1), size):
                regs = setsketch.registers(v, o)
                body = [v[o[i] : o[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(h1), pa.array(h2), pa.array(np.diff(o), pa.int64()), pa.array(body, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "h1", "h2", "n", "members", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n long, members binary, regs binary")


def _band_rows(sketches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(1)])
                keys = setsketch.band_keys(regs, ROWS_PER_BAND)
                own, n = np.asarray(b.column(0)), np.asarray(b.column(2))
                few = np.flatnonzero(n <= SMALL)
                more = [setsketch.small_keys(np.frombuffer(b.column(3)[i].as_buffer(), np.uint64)) for i in few.tolist()]
                ids = np.concatenate((np.repeat(own, keys.shape[1]), np.repeat(own[few], n[few] + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate((keys.ravel(), *more)).view(np.int64))], ["doc_id", "bucket"])

    # the full sets are read where they are small only
    return sketches.select("doc_id", "regs", "n", F.when(F.col("n") <= SMALL, F.col("members")).alias("members")).mapInArrow(run, "doc_id long, bucket long")


def _alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted distinct hashes."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return den * same >= num * (len(a) + len(b) - same)


def _verify_pairs(pairs: DataFrame, num: int, den: int, slack: float) -> DataFrame:
    """The pairs ``(a, b)`` in reach by likelihood whose full sets reach the threshold."""
    least = num / den - slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column(c)]) for c in ("ra", "rb"))
            guess = setsketch.joint_jaccard(ra, rb, np.asarray(t.column("na")), np.asarray(t.column("nb")))
            sa, sb = t.column("sa"), t.column("sb")
            good = [i for i in np.flatnonzero(guess >= least) if _alike(np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64), num, den)]
            yield t.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return pairs.mapInArrow(run, "a long, b long")


def _block_links(num: int, den: int, slack: float):
    """Links across components between two blocks of a neighbourhood; at most one for each two components that meet."""
    least, m = num / den - slack, setsketch.M
    floor = int(m * (num / den) - 7 * (m * 0.25) ** 0.5)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        doc, n, comp, block = (np.asarray(t.column(c)) for c in ("doc_id", "n", "component", "block"))
        regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("regs")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
        left, right = key[1].as_py(), key[2].as_py()
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a_rows, b_rows = np.flatnonzero(block == left), np.flatnonzero(block == right)
        out: list[tuple[int, int]] = []
        for i in a_rows:
            other = b_rows[(comp[b_rows] != comp[i]) & (n[b_rows] * num <= n[i] * den) & (n[i] * num <= n[b_rows] * den)]
            if left == right:
                other = other[doc[other] > doc[i]]
            if not len(other):
                continue
            other = other[(regs[other] == regs[i]).sum(axis=1) >= floor]
            if not len(other):
                continue
            guess = setsketch.joint_jaccard(regs[other], np.broadcast_to(regs[i], (len(other), m)), n[other], np.full(len(other), n[i]))
            order = np.argsort(-guess)
            for j in other[order[guess[order] >= least]]:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and _alike(sets[i], sets[j], num, den):
                    root[max(x, y)] = min(x, y)
                    out.append((int(doc[i]), int(doc[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, slack: float = 0.14) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Documents are linked if ``den * |A & B| >= num * |A | B|`` over their distinct word shingles;
    ``component_id`` is the least id reachable and ``kept`` marks it.  Null and empty texts, and texts
    without words, have an empty set and are alone.  Rows with a null id are returned with a null
    component, not kept, and link with nothing; repeated rows are returned as often as they come.
    Columns other than the two are ignored.
    """
    spark = session(docs)
    small_batches(spark)
    docs = need(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.where("doc_id is not null")
    rows = cut(word_classes(docs, shingle))
    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    total, n_classes = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    lonely = _lonely(known, shingle, max(1, -(-int(total) // SHARD)), max(8, -(-n_classes // RANGE)))
    alive = classes.join(lonely, ["h1", "h2"], "left").where(F.coalesce("lonely", F.lit(0)) * den <= (den - num) * F.col("n_shingles")).select(F.col("rep").alias("doc_id"), "h1", "h2")
    alive = cut(alive)
    # a repeated id may carry several texts, which share its links: the class's hash picks the rows
    texts = known.join(alive.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # as many survive as there are copies: no broadcast
    sketches = cut(_sketches(texts, shingle).join(alive, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]))
    buckets = _band_rows(sketches)
    heads = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "a")
    stars = cut(buckets.join(heads, "bucket").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("members").alias(f"s{x}"))
    links = cut(_verify_pairs(stars.join(side("a"), "a").join(side("b"), "b"), num, den, slack))
    first = cut(components(links))
    area = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("area"))
    member = area.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = cut(member)
    # one row for each neighbourhood of several components, written so that AQE can split the join on a hot one
    sizes = member.groupBy("area", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("area").agg(F.count(F.lit(1)).alias("parts"), F.ceil(F.sum("k") / BLOCK).cast("int").alias("blocks"), F.max_by("component", F.struct("k", "component")).alias("main"))
    mixed = cut(mixed.where("parts > 1").select("area", "blocks", "main"))
    # members of an area's largest component stand once for each block of others; all others meet everything
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    ranked = member.join(mixed, "area").withColumn("block", F.when(F.col("component") == F.col("main"), block).otherwise(-1 - block))
    counts = ranked.select("area", "block").distinct()
    pairs = counts.alias("l").join(counts.alias("r"), (F.col("l.area") == F.col("r.area")) & (F.col("l.block") <= F.col("r.block")) & (F.col("l.block") < 0))
    pairs = pairs.select(F.col("l.area").alias("area"), F.col("l.block").alias("lb"), F.col("r.block").alias("rb"))
    sent = pairs.select("area", "lb", "rb", F.explode(F.array_distinct(F.array("lb", "rb"))).alias("block"))
    body = ranked.select("area", "block", "doc_id", "component").join(sketches, "doc_id")
    more = body.join(sent, ["area", "block"]).groupBy("area", "lb", "rb").applyInArrow(_block_links(num, den, slack), "a long, b long")
    more = cut(more)
    ends = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if more.limit(1).count() else first
    discard(alive, sketches, stars, links, member, mixed, more)
    named = classes.join(ends.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("found"))
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("found")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` but for those that a document of a lower id stands for; rows with a null id stay."""
    gone = near_duplicates(docs, **how).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
