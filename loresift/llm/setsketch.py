"""SetSketch registers (Ertl, VLDB 2021) in numpy: exponentially spaced truncated minima.

Register ``i`` holds ``floor(1 - log_b(x_i))`` cut to 0..q+1, where ``x_i`` is the least of exponential
values that the set's elements drew for it.  Two sketches merge by the register-wise maximum, and registers
of similar sets agree with a probability near their Jaccard index, so bands of them are hash keys.
"""

from __future__ import annotations

import numpy as np

from loresift.llm.wordhash import mix

M, BASE, RATE, Q = 256, 1.001, 20.0, (1 << 16) - 2
_LOG_B = float(np.log(BASE))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def registers(value: np.ndarray, off: np.ndarray, m: int = M) -> np.ndarray:
    """One row of ``m`` registers (uint16) for each set ``value[off[i]:off[i+1]]``; an empty set's are 0.

    Every element visits the registers in an order of its own (a quadratic permutation), with values that grow by
    truncated exponential steps (variant 2 of the paper); it drops out once its value can't lower any register.
    """
    rows = len(off) - 1
    low = np.full((rows, m), np.inf)
    doc = np.repeat(np.arange(rows), np.diff(off))
    start, step = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(value + _GOLD) | np.uint64(1)
    bend = (step >> np.uint64(32)) << np.uint64(1)  # an odd step and an even bend: a permutation modulo a power of two
    seed, flat = value, low.ravel()
    for j in range(m):
        a, b = np.log(m / (m - j)), np.log(m / (m - j - 1)) if j + 1 < m else np.inf
        u = _unit(mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        x = a - np.log1p(-u * -np.expm1(-(b - a))) if np.isfinite(b) else a - np.log(u)  # x in [a, b), in units of 1/RATE
        at = doc * m + ((start + np.uint64(j) * step + np.uint64(j * j) * bend) & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(flat, at, x)
        live = b < low.max(axis=1)
        if not live.any():
            break
        if not live.all() or j == 0:
            keep = live[doc]
            doc, start, step, bend, seed = doc[keep], start[keep], step[keep], bend[keep], seed[keep]
        if not len(doc):
            break
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low / RATE) / _LOG_B)
    k[~np.isfinite(low)] = 0
    return np.clip(k, 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of ``m // rows`` bands of ``rows`` registers, one column for each band."""
    bands = regs.shape[1] // rows
    r = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(regs), bands)).copy()
    for i in range(rows):
        key = mix(key ^ (r[:, :, i] + np.uint64(i + 1) * np.uint64(1 << 20)))
    return key


def small_keys(value: np.ndarray) -> np.ndarray:
    """Bucket keys of a small set: one for all of it and one for it without each of its elements.

    Two sets, of which one has under eight elements, are alike in 80 % only if they share such a key, as they
    differ by one element at most.
    """
    each = mix(value ^ np.uint64(0x5BD1E9955BD1E995))
    whole = each.sum(dtype=np.uint64)
    return mix(np.append(whole - each, whole) + np.uint64(0x2545F4914F6CDD1D))


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard index of sketch pairs, from how many registers are larger, equal and smaller.

    The sets' sizes are known here, so the Jaccard index is the one free parameter; the likelihood is
    concave in it and golden-section search finds its top.
    """
    d1, d2 = (a > b).sum(axis=1), (a < b).sum(axis=1)
    d0 = a.shape[1] - d1 - d2
    total = np.maximum(n_a + n_b, 1).astype(np.float64)
    u, v = n_a / total, n_b / total
    top = np.where(np.maximum(u, v) > 0, np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-300), 0.0)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_B

    def ll(j):
        p1, p2 = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return d1 * np.log(np.maximum(p1, tiny)) + d2 * np.log(np.maximum(p2, tiny)) + d0 * np.log(np.maximum(1 - p1 - p2, tiny))

    lo, hi = np.zeros_like(top), top
    g = (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = ll(x) >= ll(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2
