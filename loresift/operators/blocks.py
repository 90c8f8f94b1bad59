"""Scores of whole blocks in numpy, inside Spark's tasks: rounding as Spark rounds, and the best of each query of a block."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Queries that are scored at once.
TILE = 256
#: Rows that Python workers get at once; texts may be long.
ARROW_ROWS, ARROW_BYTES = "1024", 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch, so that long rows don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= int(ARROW_ROWS):
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, f"{ARROW_BYTES}b").rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def near_tie(x: np.ndarray, digits: int) -> np.ndarray:
    """Where the last bits of a number can decide how it is rounded."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.abs(np.mod(np.abs(x) * 10.0**digits, 1.0) - 0.5) < 1e-4


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as ``F.round`` does it: by the shortest decimal form, halves away from 0; never -0."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)
    out = np.where(np.isfinite(x) & (np.abs(x) < 1e9), out, x)
    odd = np.flatnonzero((near_tie(x, digits) | (np.abs(x) >= 1e9)) & np.isfinite(x))
    if len(odd):
        values, back = np.unique(x[odd], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[odd] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) if abs(v) < 1e15 else float(v) for v in values])[back]
    return out + 0.0


def candidates(scores: np.ndarray, top_n: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every score that can be among its row's best ``top_n`` once scores are rounded, all ties included."""
    if scores.shape[1] > top_n:
        kth = np.partition(scores, scores.shape[1] - top_n, axis=1)[:, scores.shape[1] - top_n]
        kth = np.where(np.isnan(kth), np.inf, kth)  # NaN stands above all numbers, as in Spark's order
        return np.nonzero(~(scores < (kth - 1.01 * 10.0**-digits)[:, None]))
    return tuple(i.ravel() for i in np.indices(scores.shape))


def best(query: np.ndarray, score: np.ndarray, pos: np.ndarray, top_n: int) -> np.ndarray:
    """The places of each query's best ``top_n`` by falling score, then ``pos``."""
    order = np.lexsort((pos, -np.where(np.isnan(score), np.inf, score), query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < top_n]


def lengths(lists) -> np.ndarray:
    """How long the lists of an Arrow column are; nulls count as empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def saturated(tf: np.ndarray, dl: np.ndarray, avgdl, p) -> np.ndarray:
    """What BM25 makes of a term's count in a document, before the term's own weight."""
    return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / avgdl))


def many_of(p, types: pa.Schema):
    """A function of one block of documents ``(doc, pos, ws, avgdl)`` and one of queries ``(query, terms, weights)`` of a corpus: each query's best documents."""

    def run(key, docs: pa.Table, queries: pa.Table) -> pa.Table:
        docs, queries = docs.combine_chunks(), queries.combine_chunks()
        if not len(docs) or not len(queries):
            return types.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        n, dl, pos = len(docs), lengths(column(docs, "ws")), column(docs, "pos").to_numpy()
        asked = column(queries, "terms").flatten()
        words = pc.unique(asked)
        code = pc.fill_null(pc.index_in(column(docs, "ws").flatten(), words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cells, tf = np.unique((code * n + np.repeat(np.arange(n), dl))[code >= 0], return_counts=True)
        at = cells % n
        value = saturated(tf, dl[at], column(docs, "avgdl")[0].as_py(), p)
        begin = np.searchsorted(cells, np.arange(len(words) + 1) * n)
        term, weight = pc.index_in(asked, words).to_numpy(zero_copy_only=False), column(queries, "weights").flatten().to_numpy(zero_copy_only=False)
        ends, found = np.r_[0, np.cumsum(lengths(column(queries, "terms")))], []
        for k in range(0, len(queries), TILE):
            size = min(TILE, len(queries) - k)
            scores = np.zeros((size, n))
            for r in range(size):
                for e in range(ends[k + r], ends[k + r + 1]):
                    here = slice(begin[term[e]], begin[term[e] + 1])
                    scores[r, at[here]] += weight[e] * value[here]
            i, j = candidates(scores, p.top_n, p.digits)
            x = half_up(scores[i, j], p.digits)
            keep = best(i, x, pos[j], p.top_n)
            found.append((k + i[keep], j[keep], x[keep]))
        q, d, x = (np.concatenate(c) for c in zip(*found, strict=True))
        q, d = pa.array(q), pa.array(d)
        corpus = pa.repeat(column(docs, "corpus")[0], len(q))
        return pa.Table.from_arrays([corpus, column(queries, "query").take(q), column(docs, "doc").take(d), column(docs, "pos").take(d), pa.array(x)], names=types.names)

    return run


def own_of(p, keep: list[str]):
    """A function over batches of questions ``(asked, texts, ids)``, tokens all but the ids: the ids of each one's best own texts, as ``items``."""

    def ranked(asked: pa.Array, texts: pa.Array, ids: pa.Array) -> pa.Array:
        rows, docs = len(asked), texts.flatten()
        corpus, dl = np.repeat(np.arange(rows), lengths(texts)), lengths(docs)
        n = np.bincount(corpus, minlength=rows)
        pos = np.arange(len(docs))
        coded = docs.flatten().dictionary_encode()
        words, code = max(1, len(coded.dictionary)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cells, tf = np.unique(np.repeat(pos, dl) * words + code, return_counts=True)
        doc, term = cells // words, cells % words
        terms, back, df = np.unique(corpus[doc] * words + term, return_inverse=True, return_counts=True)
        of = terms // words
        idf = np.log(n[of] - df + 0.5) - np.log(df + 0.5)
        mean = np.bincount(of, idf, minlength=rows) / np.maximum(1, np.bincount(of, minlength=rows))
        idf = np.where(idf >= 0, idf, p.eps * mean[of])
        code = pc.fill_null(pc.index_in(asked.flatten(), coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = (np.repeat(np.arange(rows), lengths(asked)) * words + code)[code >= 0]
        qtf = np.searchsorted(np.sort(wanted), terms, "right") - np.searchsorted(np.sort(wanted), terms, "left")
        avgdl = np.bincount(corpus, dl, minlength=rows) / np.maximum(1, n)
        part = (qtf * idf)[back] * saturated(tf, dl[doc], avgdl[corpus[doc]], p)
        order = best(corpus, half_up(np.bincount(doc, part, minlength=len(docs)).astype(np.float64), p.digits), pos, p.top_n)
        ends = np.r_[0, np.cumsum(np.minimum(n, p.top_n))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.flatten().take(pa.array(order)))

    def run(batches):
        for batch in batches:
            items = ranked(*[batch.column(c) for c in ("asked", "texts", "ids")])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], items], names=[*keep, "items"])

    return run
