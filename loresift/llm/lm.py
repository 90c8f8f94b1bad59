"""LM scoring by a gated recurrent model over whole documents (operator 2).

The corpus is counted first: every word of every training document.  The most frequent words are the head
and have output units of their own; all others fall into tail classes by their endings, and within one a word has its
add-half share of the class's counts, one unknown word included.  Every text is then split once more and written as a
row of model inputs, which training and scoring read.

The recurrent model (``gru``) predicts classes and head words.  It starts from a sample of documents in the driver.
Then the training documents are dealt to replicas by a hash of their id and content, as many as the corpus's tokens call
for; each is trained on all of its documents, whole, with a gradient in every window, and the replicas are averaged by
tokens in a fixed order.  Thus scores don't depend on how the input is cut into files or partitions.

Counts of the ``KNOWN`` most frequent words travel with the code, bounded; rarer words of a document are joined
with the table of counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.llm import gru
from loresift.llm.common import cut, need, session, small_batches

HEAD, HEAD_CLASSES, TAIL_CLASSES = 1024, 32, 64
#: Words whose counts every worker holds.
KNOWN = 300_000
#: Documents that the start in the driver learns from, about; each of them is taken whole.
START_DOCS = 800
#: Training tokens of a replica, about.
REPLICA_TOKENS = 2_000_000
#: Replicas' weights that are added up at once.
FAN = 32
#: Texts of more tokens are handled together, apart from the others, so that lanes are alike.
LONG = 2_500
#: Tokens handled at once in a worker; lanes in training.
TRAIN_TOKENS, ENCODE_TOKENS, SCORE_TOKENS = 1_000_000, 500_000, 1_000_000
TRAIN_LANES = 512
END = b""
_LN10 = float(np.log(10))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased, and the end token."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL_CLASSES


@dataclass
class Vocabulary:
    """Totals of the training tokens, the head's layout and the known words' counts."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    layout: gru.Layout
    least: int  # words of at least this count are known; 0: none is
    place: dict[bytes, int] | None = None

    def known(self) -> dict[bytes, int]:
        """The place of each known word; made once in a worker."""
        if self.place is None:
            self.place = {w: i for i, w in enumerate(self.words)}
        return self.place

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def log_tail(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tail_tokens[k] + 0.5 * (self.tail_words[k] + 1)))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all tokens of ``docs(text)``; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                count.update(words_of(t))
                if len(count) > 200_000:
                    yield out()
                    count.clear()
        if count:
            yield out()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals of ``counts(word, c)`` and its most frequent words, ``KNOWN`` at most; equal counts by the word.

    The least count that is known is found on a histogram, so only known words come to the driver.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    room, least = KNOWN, 0
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect():  # a thousand rows at most
        if r["n"] > room:
            break
        room, least = room - r["n"], r["c"]
    top = sorted(zip((-x for x in found["c"].to_pylist()), found["word"].to_pylist(), strict=True)) if (found := counts.where(F.col("c") >= least).toArrow() if least else None) else []
    words, c = [w for _, w in top], np.array([-n for n, _ in top], np.int64)
    head = min(HEAD, len(words))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
        for b in batches:
            k = np.array([tail_class(w) for w in b.column(0).to_pylist()], np.int64)
            tokens += np.bincount(k, weights=np.asarray(b.column(1)), minlength=TAIL_CLASSES).astype(np.int64)
            distinct += np.bincount(k, minlength=TAIL_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL_CLASSES)), pa.array(tokens), pa.array(distinct)], ["k", "n", "v"])

    tail_n, tail_v = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for r in counts.mapInArrow(classes, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    tokens, distinct = int(tail_n.sum()), int(tail_v.sum())
    for w, n in zip(words[:head], c[:head], strict=True):
        k = tail_class(w)
        tail_n[k] -= n
        tail_v[k] -= 1
    share = np.cumsum(np.sqrt(c[:head])) if head else np.empty(0)
    cls = np.minimum((share / share[-1] * HEAD_CLASSES * 0.9999).astype(int), HEAD_CLASSES - 1) if head else share.astype(int)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(cls)) + 1, [head])) if head else np.zeros(1, int)
    return Vocabulary(tokens, distinct, words, c, tail_n, tail_v, gru.Layout(head, TAIL_CLASSES, bounds), least)


_ROW = "uid long, doc_id long, learn boolean, deal long, n_tokens long, n_known long, base double, inner double, ids binary, word binary, tf long, k int"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}
_FIELDS = {x.split()[0]: _TYPES[x.split()[1]] for x in _ROW.split(", ")}


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``_ROW``; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _FIELDS.items()], list(_FIELDS))


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``_ROW``: a row for each of ``docs(doc_id, text, learn)``, and one for each rarer word of it.

    ``ids`` are the model's inputs as 16-bit numbers, ``deal`` is a hash of them and of the id, ``base`` and ``inner`` are sums over
    the known words: of the base score, and of tail words within their classes.
    """
    shared = session(docs).sparkContext.broadcast(v)  # bounded by KNOWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get, head = v.known().get, v.layout.head
        k = np.fromiter(map(tail_class, v.words[head:]), np.int64, len(v.words) - min(head, len(v.words)))
        row_of = np.concatenate((np.arange(head), head + k, [0])).astype(np.int16)
        base_of = np.append(v.log_base(v.counts), 0.0)
        inner_of = np.concatenate((np.zeros(head), v.log_tail(v.counts[head:], k) if len(k) else [], [0.0]))
        uid = TaskContext.get().partitionId() << 33

        def out(ids: list, learn: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal uid
            n = len(ids)
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            at = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int64, int(off[-1]))
            row = row_of[at]
            lost = np.flatnonzero(at < 0)
            rare: Counter[tuple[int, bytes]] = Counter()
            if len(lost):
                doc = np.searchsorted(off, lost, "right") - 1
                words = [texts[d][i] for d, i in zip(doc.tolist(), (lost - off[doc]).tolist(), strict=True)]
                row[lost] = head + np.fromiter(map(tail_class, words), np.int64, len(words))
                rare.update(zip(doc.tolist(), words, strict=True))
            data = row.astype("<i2").tobytes()
            ends = (2 * off).astype(np.int32)
            mine = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            view = memoryview(data)
            deal = [zlib.crc32(view[2 * a : 2 * b], zlib.crc32(str(i).encode())) for i, a, b in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True)]
            add = lambda x: pa.array(np.add.reduceat(x, off[:-1]))
            yield _batch(n, uid=pa.array(np.arange(uid, uid + n)), doc_id=pa.array(ids, pa.int64()), learn=pa.array(learn, pa.bool_()), deal=pa.array(deal, pa.int64()), n_tokens=pa.array(np.diff(off)), n_known=add((at >= 0).astype(np.int64)), base=add(base_of[at]), inner=add(inner_of[at]), ids=mine)
            if rare:
                d, w = zip(*rare, strict=True)
                yield _batch(len(d), uid=pa.array(uid + np.array(d, np.int64)), word=pa.array(w, pa.binary()), tf=pa.array(list(rare.values()), pa.int64()), k=pa.array([tail_class(x) for x in w], pa.int32()))
            uid += n

        ids, learn, texts, size = [], [], [], 0
        for b in batches:
            for i, t, yes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "learn")), strict=True):
                ids.append(i)
                learn.append(yes)
                texts.append(words_of(t))
                size += len(texts[-1])
                if size >= ENCODE_TOKENS:
                    yield from out(ids, learn, texts)
                    ids, learn, texts, size = [], [], [], 0
        if ids:
            yield from out(ids, learn, texts)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "learn").mapInArrow(run, _ROW)


class _Groups:
    """Gathers documents until they have about ``most`` tokens together; long and short ones apart, so that lanes are alike."""

    def __init__(self, most: int):
        self.most, self.held, self.n = most, {False: [], True: []}, {False: 0, True: 0}

    def put(self, tag: object, ids: np.ndarray) -> list[tuple]:
        """What is complete with this document: nothing, or its group."""
        long = len(ids) > LONG
        self.held[long].append((tag, ids))
        self.n[long] += len(ids)
        if self.n[long] < self.most:
            return []
        full, self.held[long], self.n[long] = self.held[long], [], 0
        return full

    def rest(self) -> list[list[tuple]]:
        left = [x for x in self.held.values() if x]
        self.held, self.n = {False: [], True: []}, {False: 0, True: 0}
        return left


def _flat(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x for _, x in group]).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for _, x in group])))


def _ids(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<i2")


def _summed(replicas: DataFrame, n: int) -> list[tuple[int, np.ndarray]]:
    """``(tokens, weights times tokens)`` of ``replicas(r, n, w)``, added up in the order of ``r`` until ``FAN`` rows are left at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, total = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["r", "n", "w"])

        for b in batches:
            for r, m, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if total is not None and r // FAN != now:
                    yield row()
                    tokens, total = 0, None
                now, x = r // FAN, np.frombuffer(w.as_buffer(), np.float64)
                tokens, total = tokens + m, x.copy() if total is None else total + x
        if total is not None:
            yield row()

    while n > FAN:
        n = -(-n // FAN)
        replicas = replicas.repartition(n, F.floor(F.col("r") / FAN)).sortWithinPartitions("r").mapInArrow(add, "r long, n long, w binary")
    rows = sorted((r["r"], r["n"], bytes(r["w"])) for r in replicas.collect())  # FAN rows at most
    return [(m, np.frombuffer(w, np.float64)) for _, m, w in rows]


def train(rows: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """The averaged weights after one pass over all of ``rows(deal, ids)``."""
    spark = session(rows)
    layout = v.layout
    params = gru.new_params(layout, v.counts[: layout.head].astype(float), v.tail_tokens.astype(float))
    if not v.tokens:
        return params
    first = gru.Trainer(params, layout, rate=0.1)
    documents = max(1, int(v.counts[v.words.index(END)]) if END in v.words else 1)
    part = int(min(1.0, START_DOCS / documents) * (1 << 32))
    some = sorted((r["deal"], bytes(r["ids"])) for r in rows.where(F.col("deal") < part).select("deal", "ids").collect())  # about START_DOCS documents
    if some:
        first.learn(*_flat([(d, np.frombuffer(x, "<i2")) for d, x in some]), lanes=64)
    shared = spark.sparkContext.broadcast((layout, first.p, first.g2))  # bounded by HEAD
    names = sorted(params)
    shapes = [params[k].shape for k in names]
    replicas = max(1, -(-v.tokens // REPLICA_TOKENS))

    def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, p, g2 = shared.value
        now, t, groups = None, None, _Groups(TRAIN_TOKENS)

        def done() -> Iterator[pa.RecordBatch]:
            for g in groups.rest():
                t.learn(*_flat(g), lanes=TRAIN_LANES)
            flat = np.concatenate([t.p[k].ravel() for k in names]).astype(np.float64) * t.tokens
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([t.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["r", "n", "w"])

        for b in batches:
            for r, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if r != now:
                    if t is not None:
                        yield from done()
                    now, t = r, gru.Trainer(p, layout, rate=0.05)
                    t.g2 = {k: x.copy() for k, x in g2.items()}
                if full := groups.put(None, _ids(ids)):
                    t.learn(*_flat(full), lanes=TRAIN_LANES)
        if t is not None:
            yield from done()

    dealt = rows.select((F.col("deal") % replicas).alias("r"), "ids", "deal").repartition(replicas, "r").sortWithinPartitions("r", "deal", "ids")
    sums = _summed(dealt.select("r", "ids").mapInArrow(replica, "r long, n long, w binary"), replicas)
    n = sum(m for m, _ in sums)
    if not n:
        return first.p
    flat = sum(w for _, w in sums) / n
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return {k: x.reshape(s).astype(np.float32) for k, x, s in zip(names, parts, shapes, strict=True)}


def _likely(rows: DataFrame, v: Vocabulary, params: dict[str, np.ndarray]) -> DataFrame:
    """``_SCORED``: with the log10 probability that the recurrent model gives to classes and head words, and ``inner``, as the score."""
    shared = session(rows).sparkContext.broadcast((v.layout, params))  # bounded by HEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, p = shared.value
        groups = _Groups(SCORE_TOKENS)

        def out(group: list[tuple]) -> pa.RecordBatch:
            flat, off = _flat(group)
            ll = gru.log_likelihood(p, flat, off, layout).astype(np.float64) / _LN10
            return pa.RecordBatch.from_arrays([pa.array([u for (u, *_), _ in group], pa.int64()), *[pa.array([x[k] for x, _ in group], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))], pa.array(np.add.reduceat(ll, off[:-1]) + np.array([x[5] for x, _ in group]))], _SCORED_NAMES)

        for b in batches:
            for *facts, ids in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "n_tokens", "n_known", "base", "inner")), b.column("ids"), strict=True):
                if full := groups.put(tuple(facts), _ids(ids)):
                    yield out(full)
        for g in groups.rest():
            yield out(g)

    return rows.select("uid", "doc_id", "n_tokens", "n_known", "base", "inner", "ids").mapInArrow(run, _SCORED)


_SCORED = "uid long, doc_id long, n_tokens long, n_known long, base double, score double"
_SCORED_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def score(docs: DataFrame, held_out: Callable[[], Column]) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text)``.

    Learns from the rows for which ``held_out()`` isn't true.  Null and empty texts are the end token alone; null
    ids are scored and count as training rows unless held out; repeated rows count and are scored each.  An
    empty table gives an empty result; without training rows the shares are those of no counts.
    """
    spark = session(docs)
    small_batches(spark)
    docs = need(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text", (~F.coalesce(held_out(), F.lit(False))).alias("learn"))
    counts = cut(word_counts(docs.where("learn")))
    v = vocabulary(counts)
    rows = cut(encoded(docs, v))
    texts = rows.where("word is null")
    params = train(texts.where("learn").select("deal", "ids"), v)
    rarer = counts.where(F.col("c") < v.least) if v.least else counts
    words = rows.where("word is not null").select("uid", "word", "tf", "k").join(rarer, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = float(v.tokens + 0.5 * (v.distinct + 1))
    tail = F.array(*[F.lit(float(n + 0.5 * (d + 1))) for n, d in zip(v.tail_tokens, v.tail_words, strict=True)])
    per = words.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / whole)).alias("more_base"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.get(tail, F.col("k")))).alias("more_score"),
    )
    out = _likely(texts, v, params).join(per, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )
