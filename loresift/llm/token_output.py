"""Token-id output in range-coded blocks (operator 3).

Documents are sorted by id over range partitions; each task encodes its texts with a public tokenizer, ends every
document with the id 0 and writes blocks of whole documents, coded by ``rangecoder``, through Spark's own
writer: one row for each block in a Parquet container, so that a lost executor only repeats its task and any file system
that Spark knows will do.  Reading checks the checksums of every block and gives back each document's ids.

Rows of a written folder: ``part`` and ``seq`` (the order of blocks), ``before`` (ids of the part's earlier blocks),
``n_docs``, ``n_tokens``, ``doc_ids`` and ``lengths`` (little-endian 64 and 32-bit integers), ``head_crc`` (of all
of these) and ``body``, a block as ``rangecoder`` describes it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.llm import rangecoder
from loresift.llm.common import need, session, shared_dir, small_batches

END = 0
#: Words whose ids a worker remembers; beyond that it forgets those that it met in one call only.
REMEMBERED = 1_200_000
#: New words that are encoded in one call.
TOGETHER = 4_096
BLOCKS = "part int, seq int, before long, n_docs long, n_tokens long, doc_ids binary, lengths binary, head_crc long, body binary"


def default_tokenizer() -> str:
    """The place of the byte-level BPE among the public vocabulary files of the box."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library behind a memory of words.

    Byte-level BPE never joins what stands before a single space with that space, unless other white space stands
    next to it, so a text is cut before its single spaces, and each distinct piece is encoded once; Arrow cuts the texts of
    a call and tells the distinct pieces, and only those are looked up.  A text with a space
    beside any white space, U+00A0 and the like too, is encoded whole: one of its pieces is empty, or begins or
    ends with white space.  ``str.isspace`` has all that the tokenizer's own pattern takes for white space, and more.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the worker is one of many already
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        kind = self.lib.pre_tokenizer
        self.cuts = kind is not None and "ByteLevel" in str(kind) and "use_regex=True" in str(kind) and self.lib.normalizer is None and self.lib.post_processor is None
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # in byte-level vocabularies a space is written as this letter; pieces hold it only as their first byte
        self.spaced = np.zeros(self.size, bool)
        for token, i in self.lib.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")
        self.known = _Numbered()
        self.ids = np.zeros(1 << 16, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.odd, self.again = np.zeros(1 << 14, bool), np.zeros(1 << 14, bool)
        self.used = self.n = 0

    def _forget(self) -> None:
        """Keeps the pieces that were met in a second call since the last time, if they aren't most of all."""
        stay = np.flatnonzero(self.again[: self.n])
        stay = stay if 2 * len(stay) <= self.n else stay[:0]
        pieces = list(self.known)
        self.known = _Numbered(zip([pieces[k] for k in stay.tolist()], range(len(stay)), strict=True))
        where, n = self._places(stay)
        self.used, self.n = len(where), len(stay)
        self.ids[: self.used] = self.ids[where]
        self.odd[: self.n] = self.odd[stay]
        self.start[1 : self.n + 1] = np.cumsum(n)
        self.again[:] = False

    def _places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of the pieces are, how many each has)."""
        lo = self.start[k]
        n = self.start[k + 1] - lo
        where = np.repeat(lo - np.cumsum(n) + n, n)
        where += np.arange(len(where))
        return where, n

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.ids.dtype)

    def _learn(self) -> None:
        """Encodes the pieces that were numbered since the last time, each after a space, many in one call."""
        pieces = self.known.new
        for lo in range(0, len(pieces), TOGETHER):
            some = pieces[lo : lo + TOGETHER]
            odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in some), bool, len(some))
            good = [p for p, x in zip(some, odd.tolist(), strict=True) if not x] if odd.any() else some
            got = self._whole(" " + " ".join(good)) if good else self.ids[:0]
            first = np.flatnonzero(self.spaced[got])  # a piece begins at each space
            if len(first) != len(good):
                raise RuntimeError("the tokenizer joined words across a space")
            sizes = np.zeros(len(some), np.int64)
            sizes[~odd] = np.diff(np.append(first, len(got)))
            used, n = self.used + len(got), self.n + len(some)
            while len(self.ids) < used:
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while len(self.start) <= n:
                self.start = np.concatenate((self.start, np.zeros_like(self.start)))
                self.odd = np.concatenate((self.odd, np.zeros_like(self.odd)))
                self.again = np.concatenate((self.again, np.zeros_like(self.again)))
            self.ids[self.used : used] = got
            self.start[self.n + 1 : n + 1] = self.used + np.cumsum(sizes)
            self.odd[self.n : n] = odd
            self.used, self.n = used, n
        self.known.new = []

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null texts are empty."""
        if len(self.known) > REMEMBERED:
            self._forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("")
        if not self.cuts:
            return [self._whole(t) if t else self.ids[:0] for t in texts.to_pylist()]
        cut = pc.split_pattern(texts, " ")
        pieces, first = cut.flatten().dictionary_encode(), np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))))
        words, index = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        heads = index[first[:-1]]
        # what only begins texts is never met after a space
        after = np.ones(len(index), bool)
        after[first[:-1]] = False
        inner = np.zeros(len(words), bool)
        inner[index[after]] = True
        number = np.zeros(len(words), np.int64)
        number[inner] = k = np.fromiter(map(self.known.__getitem__, [w for w, x in zip(words, inner.tolist(), strict=True) if x]), np.int64, int(inner.sum()))
        self.again[k[k < self.n]] = True
        if self.known.new:
            self._learn()
        at, odd = number[index], (self.odd[number] & inner)[index]
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out = []
        for i, (lo, hi, head) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), [words[k] for k in heads.tolist()], strict=True)):
            if hi == lo + 1 and not head:
                out.append(self.ids[:0])
            elif special[i] or (head and head[-1].isspace()) or (hi > lo + 1 and not head) or odd[lo + 1 : hi].any():
                out.append(self._whole(texts[i].as_py()))
            else:
                where, _ = self._places(at[lo + 1 : hi])
                out.append(np.concatenate((self._whole(head) if head else self.ids[:0], self.ids[where])))
        return out


class _Numbered(dict):
    """Gives a key that it doesn't know the next number, and notes it in ``new``."""

    def __init__(self, known: Iterable[tuple[str, int]] = ()) -> None:
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def head_crc(part: int, seq: int, before: int, n_docs: int, n_tokens: int, doc_ids: bytes, lengths: bytes) -> int:
    """The checksum of what a row says about its block."""
    return zlib.crc32(lengths, zlib.crc32(doc_ids, zlib.crc32(struct.pack("<iiqqq", part, seq, before, n_docs, n_tokens))))


def blocks(docs: DataFrame, tokenizer: str, partitions: int) -> DataFrame:
    """``BLOCKS`` rows of ``docs(doc_id, text)``, range-partitioned by id; equal ids by their texts' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[np.ndarray] = []
        held = before = 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], "<u4")
            body = rangecoder.encode(np.concatenate(texts), enc.size)
            head = (part, seq, before, len(ids), held, np.array(ids, "<i8").tobytes(), lengths.tobytes())
            values = (*head, head_crc(*head), body)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], _NAMES)

        for b in batches:
            for i, got in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                got = np.append(got, enc.ids.dtype.type(END))
                if held and held + len(got) > rangecoder.BLOCK_IDS:
                    yield row()
                    ids, texts, held, before, seq = [], [], 0, before + held, seq + 1
                ids.append(NULL_ID if i is None else i)
                texts.append(got)
                held += len(got)
        if held:
            yield row()

    sorted_docs = docs.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return sorted_docs.mapInArrow(run, BLOCKS)


#: Stands for a null id in a block.
NULL_ID = -(1 << 63)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of every row of ``docs`` to the new folder ``path``, in ascending id order.

    Null texts count as empty: they are the end id alone.  Null ids come first; repeated rows are written as
    often as they come; an empty table gives a folder without blocks.  Extra columns are ignored.
    """
    spark = session(docs)
    small_batches(spark)
    docs = need(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    partitions = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks(docs, tokenizer or default_tokenizer(), partitions).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document in the folder, from its decoded blocks.

    ``start`` counts the ids of all documents before it; a damaged block fails the job.
    """
    stored = spark.read.schema(BLOCKS).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    path_of = tokenizer or default_tokenizer()
    schema = "doc_id long, part int, within long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _encoder(path_of).size
        for b in batches:
            for row in b.to_pylist():
                if head_crc(*(row[c] for c in _NAMES[:7])) != row["head_crc"]:
                    raise ValueError(f"block {row['part']}/{row['seq']}: its documents don't match their checksum")
                ids = rangecoder.decode(row["body"], size).astype("<u4")
                n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                start = np.concatenate(([0], np.cumsum(n)))
                if len(ids) != start[-1]:
                    raise ValueError(f"block {row['part']}/{row['seq']}: {len(ids)} ids for lengths of {start[-1]}")
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * start[k] : 4 * start[k + 1]]) for k in range(len(n))]
                who = np.frombuffer(row["doc_ids"], "<i8")
                cols = [pa.array(who, pa.int64(), mask=who == NULL_ID), pa.array(np.full(len(n), row["part"]), pa.int32()), pa.array(start[:-1] + row["before"]), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([bytes(raw[4 * start[k] : 4 * start[k + 1]]) for k in range(len(n))], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = stored.mapInArrow(run, schema)
    # one small row for each file, which is at most one for each writing task: decoded documents stay where they are
    joined = docs.join(F.broadcast(totals), "part")
    return joined.select("doc_id", (F.col("part_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to a new folder under the shared one and reads it back."""
    spark = session(docs)
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark, path, tokenizer)
