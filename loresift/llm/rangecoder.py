"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block's ids are cut into lanes of equal length that are coded side by side with one model, which starts
empty in every block.  Three orders are mixed.  Order 0 is the adaptive frequency of every id.  A context of order 1
(the last id) or order 2 (the last two, hashed, with a tag that tells other contexts apart) holds the ids that followed it,
``SLOTS`` of them at most, with counts.  How much each of them gets, and how much order 0 keeps, is learned for every
combination of counts of both orders; a candidate of order 1 that order 2 has too counts as empty there.  Ids that are
no candidate go by order 0, so each weight is the share of ids that go its way.  The mixture drives a range coder in every lane.

What a model does for a lane is a few table look-ups: a context is one record of ids and counts, and what happens to
counts is tabled for all that can happen.

Block layout, little-endian: magic ``TKC3``, ids (u32), lanes (u32), crc32 of the ids as u32 (u32), crc32
of all the rest of the block (u32), 16-bit words of each lane (u32 each), then the words of lane 0, lane 1, ...
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

MAGIC = b"TKC3"
_HEAD = struct.Struct("<4sIIII")
#: Ids a block aims at; lanes at most; ids a lane has at least.
BLOCK_IDS, LANES, LANE_IDS = 1 << 20, 4096, 256
#: Successors that a context of order 1, and one of order 2, remembers: a record has four cells, the last is for counts.
SLOTS = (3, 2)
MOST_IDS = 1 << 17
_F_BITS, _W_BITS = 18, 12
_TOTAL_BITS = _F_BITS + _W_BITS
_HASH_BITS, _TAG_BITS, _COUNT_BITS = 16, 12, 2
_MOST = (1 << _COUNT_BITS) - 1
_BITS2 = SLOTS[1] * _COUNT_BITS
_STATES = 1 << sum(SLOTS) * _COUNT_BITS
_PLACES = sum(SLOTS)
_AGAIN = 3  # the order-0 frequencies and the weights are rebuilt when the steps have grown by this part
_LEARN = 4  # steps between two lessons of the weights, but for the first ones
_RANGE, _BOT = (1 << 48) - 1, 1 << 32
_M32 = (1 << 32) - 1


@functools.cache
def _order(slots: int, keeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the counts of an order, packed, and its candidates that are the id (a bit each): (the candidate that gets it, its
    number for none; the counts afterwards; the cell that takes the id, the last before the counts' own or that itself for none)."""
    shape = 1 << _COUNT_BITS * slots, 1 << slots
    hits, after, takers = np.full(shape, slots, np.int64), np.empty(shape, np.int64), np.full(shape, slots, np.int64)
    for state in range(shape[0]):
        for right in range(shape[1]):
            counts = [(state >> (_COUNT_BITS * k)) & _MOST for k in range(slots)]
            hit = next((k for k, c in enumerate(counts) if c and right >> k & 1), slots)
            if hit < slots:
                counts[hit] = min(_MOST, counts[hit] + 1)
            else:
                weak = min(range(slots), key=counts.__getitem__)
                if counts[weak] > keeps:
                    counts[weak] -= 1
                else:
                    takers[state, right], counts[weak] = weak, 1
            hits[state, right], after[state, right] = hit, sum(c << (_COUNT_BITS * k) for k, c in enumerate(counts))
    return hits, after, takers


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what happens to counts, ids that are taken to have gone each way before the first, states without doubles).

    A state is the counts of order 1 and, in its low bits, those of order 2.  The first table has, for a state and the
    candidates that are the id, packed: the way the id goes (3 bits), what the counts of order 1 become (6), the cell that
    takes the id (2), and the same two for order 2 (4 and 2).  The last has, for the pairs of candidates of order 1
    and order 2 that are the same id (a bit each, order 1 first) and a state, that without order 1's counts of those.
    """
    k1, k2 = SLOTS
    bits1 = _COUNT_BITS * k1
    state, right = np.ogrid[:_STATES, : 1 << _PLACES]
    one, two = (state >> _BITS2, right & ((1 << k1) - 1)), (state & ((1 << _BITS2) - 1), right >> k1)
    (hit1, after1, taker1), (hit2, after2, taker2) = ([x[at] for x in _order(n, least)] for n, least, at in zip(SLOTS, _KEEPS, (one, two), strict=True))
    way = np.where(hit2 < k2, k1 + hit2, np.where(hit1 < k1, hit1, _PLACES))
    moves = way | (after1 | taker1 << bits1 | (after2 | taker2 << _BITS2) << (bits1 + 2)) << 3
    prior = np.zeros((_STATES, 8), np.int64)
    for k in range(k1):
        prior[:, k] = np.take(_GUESS[0], (state[:, 0] >> (_BITS2 + _COUNT_BITS * k)) & _MOST)
    for k in range(k2):
        prior[:, k1 + k] = np.take(_GUESS[1], (state[:, 0] >> (_COUNT_BITS * k)) & _MOST)
    prior[:, _PLACES] = _GUESS[2]
    pairs, state = np.ogrid[: 1 << k1 * k2, :_STATES]
    alone = pairs * 0 + state
    for i in range(k1):
        for k in range(k2):
            double = (pairs >> (i * k2 + k)) & 1 & ((state >> (_COUNT_BITS * k)) & _MOST > 0)
            alone &= ~(double * (_MOST << (_BITS2 + _COUNT_BITS * i)))
    return moves.ravel(), prior, alone.ravel()


def _bits(rows: np.ndarray) -> np.ndarray:
    """A bit for each row, the first one lowest."""
    rows = rows.view(np.uint8)
    out = rows[-1].copy()
    for row in rows[-2::-1]:
        out += out
        out += row
    return out


#: Of ids before the first: what a candidate of order 1 or 2 with such a count got, and order 0.
_GUESS = (0, 2, 3, 4), (0, 3, 6, 9), 6
#: The weakest candidate of order 1, and of order 2, goes at once with this count or less; otherwise it loses one.
_KEEPS = (1, 1)


class Model:
    """What coder and decoder learn alike, step by step."""

    def __init__(self, size: int, lanes: int):
        if not 0 < size <= MOST_IDS:
            raise ValueError(f"ids must be in 0..{MOST_IDS - 1}")
        self.size = size
        self.counts = np.zeros(size, np.int64)
        self.cum = np.zeros(size + 1, np.int64)
        self.total = 0
        self.moves, prior, self.alone = _tables()
        self.went = prior.copy()  # ids by state and way
        self.cell, record = (np.uint16, np.uint64) if size <= 1 << 16 else (np.uint32, "V16")
        self.every = np.arange(lanes)
        self.cells = 4 * self.every
        self.first, self.second = np.zeros(4 * size, self.cell).view(record), np.zeros(4 << _HASH_BITS, self.cell).view(record)
        self.found = np.zeros((_PLACES + 1, lanes), self.cell)  # the last row is for the decoder's ids of order 0
        self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.slots: np.ndarray | None = None
        self.fresh: list[np.ndarray] = []  # ids that the frequencies don't count yet
        self.spread = np.arange(size + 1)
        self.scaled = np.empty(size + 1)
        self.step = self.due = 0

    def begin(self, want_slots: bool) -> None:
        """Rebuilds the order-0 frequencies and the weights, ever more seldom."""
        if self.step == self.due:
            self.due += max(1, self.step // _AGAIN)
            if self.fresh:
                self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.size)
                self.fresh = []
            spare = (1 << _F_BITS) - self.size
            if self.total:
                np.cumsum(self.counts, out=self.cum[1:])
                np.multiply(self.cum, spare / self.total, out=self.scaled)
                np.copyto(self.cum, self.scaled, casting="unsafe")
            else:
                self.cum[:] = self.spread * spare // self.size
            self.cum += self.spread
            self.cum[-1] = 1 << _F_BITS
            if want_slots:
                self.slots = np.repeat(self.spread[:-1].astype(self.cell), np.diff(self.cum))
            went = self.went[:, :_PLACES]
            # a candidate that counts gets 1 at least, and order 0 gets 4, so every id can be coded
            part = went * ((1 << _W_BITS) - 4 - _PLACES) // self.went.sum(axis=1)[:, None] + (went > 0)
            self.weights = np.ascontiguousarray(part.T, np.int16)
            ends = np.zeros((_STATES, 8), np.int64)
            np.cumsum(part, axis=1, out=ends[:, 1 : _PLACES + 1])
            self.rest = (1 << _W_BITS) - ends[:, _PLACES]
            share, spread = np.zeros((2, _STATES, 8), np.int64)
            share[:, :_PLACES], spread[:, _PLACES] = part << _F_BITS, self.rest
            # by state and way: where its stretch begins, how wide it is, and how much of it each part of order 0 is
            self.below, self.share, self.unit = ends.ravel() << _F_BITS, share.ravel(), spread.ravel()
        self.step += 1

    def seek(self) -> np.ndarray:
        """The candidates of every lane; those of order 1 come first."""
        mixed = self.prev2 * 0x9E3779B1 + self.prev1 * 0x85EBCA6B
        self.at2 = (mixed >> 11) & ((1 << _HASH_BITS) - 1)
        mixed >>= 11 + _HASH_BITS - _BITS2
        self.mark = mixed.astype(np.uint16) & np.uint16(((1 << _TAG_BITS) - 1) << _BITS2)
        self.held1, self.held2 = self.first[self.prev1], self.second[self.at2]
        one, two = self.held1.view(self.cell).reshape(-1, 4), self.held2.view(self.cell).reshape(-1, 4)
        self.found[: SLOTS[0]] = one[:, : SLOTS[0]].T
        self.found[SLOTS[0] : _PLACES] = two[:, : SLOTS[1]].T
        # an entry of another context counts as empty
        said = two[:, 3] ^ self.mark
        said *= said < 1 << _BITS2
        self.state = one[:, 3].astype(np.int64) << _BITS2
        self.state += said
        doubles = self.found[: SLOTS[0], None] == self.found[SLOTS[0] : _PLACES]
        self.shown = self.alone[(_bits(doubles.reshape(-1, len(said))).astype(np.int64) * _STATES) + self.state]
        return self.found[:_PLACES]

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidates, weights, weight of order 0) of every lane.

        The weights of a lane add up to ``1 << _W_BITS``.
        """
        found = self.seek()
        return found, self.weights.take(self.shown, axis=1, mode="clip"), self.rest[self.shown]

    def learn(self, sym: np.ndarray, right: np.ndarray) -> None:
        """Notes the way that each id goes: a candidate, or after the last one order 0.  ``right``: which candidates are the id."""
        move = self.moves[(self.state << _PLACES) + _bits(right)]
        self.at = (self.shown << 3) + (move & 7)
        if self.step % _LEARN == 0 or self.step < 16:
            self.went += np.bincount(self.at, minlength=8 * _STATES).reshape(-1, 8)
        self.fresh.append(sym)
        self.total += len(sym)
        move >>= 3
        cell = sym.astype(self.cell)
        self._put(self.first, self.prev1, self.held1, cell, move, SLOTS[0], 0)
        move >>= _COUNT_BITS * SLOTS[0] + 2
        self._put(self.second, self.at2, self.held2, cell, move, SLOTS[1], self.mark)
        self.prev2, self.prev1 = self.prev1, sym

    def _put(self, table: np.ndarray, at: np.ndarray, held: np.ndarray, sym: np.ndarray, move: np.ndarray, slots: int, mark) -> None:
        """Writes contexts back with their new counts and, in the cell that takes it, the id."""
        cells = held.view(self.cell)
        bits = _COUNT_BITS * slots
        cells[self.cells + ((move >> bits) & 3)] = sym
        cells[3::4] = (move & ((1 << bits) - 1)).astype(self.cell) | mark
        table[at] = held

    def stretch(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of the ids' stretches, after ``learn``."""
        c = self.cum[sym]
        unit = self.unit[self.at]
        start = unit * c
        start += self.below[self.at]
        unit *= self.cum[sym + 1] - c
        unit += self.share[self.at]
        return start, unit


def encode(ids: np.ndarray, size: int = 1 << 16) -> bytes:
    """One block; ``ids`` are whole numbers in ``0..size - 1``."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    grid = np.ascontiguousarray(np.concatenate((ids, np.zeros(lanes * steps - n, "<u4"))).reshape(lanes, steps).T)
    m = Model(size, lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _RANGE)
    lane, word, every = [], [], np.arange(lanes, dtype=np.int32)
    for row in grid:
        sym = row.astype(np.int64)
        m.begin(False)
        m.learn(sym, m.seek() == sym.astype(m.cell))
        start, width = m.stretch(sym)
        rng >>= _TOTAL_BITS
        low += start * rng
        rng *= width
        while len(at := np.flatnonzero(rng < _BOT)):
            x = low[at]
            lane.append(every[at])
            word.append((x >> 32).astype(np.uint32))  # 16 bits, and a carry to the word before
            low[at] = (x & _M32) << 16
            rng[at] <<= 16
    low += (1 << 16) - 1  # whatever follows the next two words
    for x in (low >> 32, (low >> 16) & 0xFFFF):
        lane.append(every)
        word.append(x.astype(np.uint32))
    lane, word = np.concatenate(lane), np.concatenate(word)
    word = word[np.argsort(lane.astype(np.uint16), kind="stable")]
    while len(at := np.flatnonzero(word >> 16)):
        word[at] &= 0xFFFF
        word[at - 1] += 1
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word.astype("<u2").tobytes()
    head = _HEAD.pack(MAGIC, n, lanes, zlib.crc32(ids.tobytes()), 0)
    return head[:-4] + struct.pack("<I", zlib.crc32(body, zlib.crc32(head[:-4]))) + body


def decode(block: bytes, size: int = 1 << 16) -> np.ndarray:
    """The ids of a block; a damaged one raises ``ValueError``."""
    if len(block) < _HEAD.size:
        raise ValueError("a block is cut short")
    magic, n, lanes, ids_crc, body_crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: _HEAD.size - 4])) != body_crc:
        raise ValueError("a block is damaged")
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate((np.frombuffer(body, "<u2", -1, 4 * lanes).astype(np.int64), np.zeros(4, np.int64)))
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    steps = -(-n // lanes)
    m = Model(size, lanes)
    code, rng = np.zeros(lanes, np.int64), np.full(lanes, _RANGE)
    for k in range(3):
        code = (code << 16) | words[at + k]
    at = at + 3
    out = np.empty((steps, lanes), "<u4")
    rows, top = lanes * np.arange(_PLACES + 1), float((1 << _TOTAL_BITS) - 1)
    for t in range(steps):
        m.begin(True)
        found, w, w0 = m.look()
        rng >>= _TOTAL_BITS
        # quotients of whole numbers under 2**48 are rounded to no other whole part
        v = np.minimum(code / rng, top).astype(np.int64)
        part = (v >> _F_BITS).astype(np.int16)
        end = w[0]
        way = (part >= end).view(np.uint8)
        for k in range(1, _PLACES):
            end += w[k]
            way += part >= end
        v -= ((1 << _W_BITS) - w0) << _F_BITS
        m.found[_PLACES] = m.slots[(np.maximum(v, 0) / w0).astype(np.int64)]
        sym = m.found.ravel()[rows[way] + m.every].astype(np.int64)
        m.learn(sym, found == sym.astype(m.cell))
        start, width = m.stretch(sym)
        code -= start * rng
        rng *= width
        while len(i := np.flatnonzero(rng < _BOT)):
            place = at[i]
            code[i] = (code[i] << 16) | words[place]
            at[i] = place + 1
            rng[i] <<= 16
        out[t] = sym
    ids = out.T.ravel()[:n]
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids
