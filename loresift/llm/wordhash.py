"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z are lower-cased, nothing else is.
Null texts count as empty.  Texts are handled whole: long ones are cut at white space only to bound
memory, which can't change a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; numpy needs about 30 times as much.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: The same, but ASCII punctuation separates words too.
PLAIN = _IS_WORD.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = False
_P = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow: np.ndarray = np.ones(1, dtype=np.uint64)
_inv: np.ndarray = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        steps = np.empty((2, max(n, CHUNK + 2)), np.uint64)
        steps[0], steps[1], steps[:, 0] = _P, pow(_P, -1, 1 << 64), 1
        _pow, _inv = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: np.ndarray, doc_starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in ``data``; words don't span ``doc_starts``."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = is_word[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[doc_starts] = True
    before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
    after = np.concatenate((word[1:], [False])) & ~cut[1:]
    s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)), s


def hashed(texts: pa.Array, is_word: np.ndarray = _IS_WORD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first row, row after the last, hashes, offsets of each row's hashes), in row order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.fill_null("").cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1)
        lo, hi = int(off[row]), int(off[last])
        if hi - lo <= CHUNK:
            h, at = _hash_piece(data[lo:hi], off[row:last] - lo, is_word)
            yield row, last, h, np.searchsorted(at, off[row : last + 1] - lo)
        else:  # one long text
            parts = []
            while lo < hi:
                end = min(lo + CHUNK, hi)
                if end < hi:
                    gaps = np.flatnonzero(~is_word[data[lo:end]])
                    if len(gaps):
                        end = lo + int(gaps[-1]) + 1
                    else:  # a word longer than a chunk
                        more = np.flatnonzero(~is_word[data[end:hi]])
                        end = end + int(more[0]) if len(more) else hi
                parts.append(_hash_piece(data[lo:end], np.zeros(1, np.int64), is_word)[0])
                lo = end
            h = np.concatenate(parts)
            yield row, last, h, np.array([0, len(h)])
        row = last


def shingles(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and their offsets.

    A row with words, but fewer than ``size``, has its whole sequence as one shingle; a row without words has none.
    """
    rows = len(off) - 1
    count = np.diff(off)
    doc = np.repeat(np.arange(rows), count)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    k = np.arange(len(h)) - np.repeat(off[:-1], count)
    value = np.zeros(len(h), np.uint64)
    room = np.repeat(count, count) - k  # words from here to the end of the row
    mul = np.uint64(0xD6E8FEB86659FD93)
    for i in range(size):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - i)] = h[i:]
        value = np.where(room > i, (value ^ part) * mul + np.uint64(i + 1), value)
    keep = (room >= size) | ((k == 0) & (np.repeat(count, count) < size))
    value, doc = mix(value[keep]), doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(rows + 1))
