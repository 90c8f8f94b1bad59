"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored output.

A token's class is predicted from the state by one softmax, and a head word within its class by another; what
a tail class holds is left to the caller.  ``h' = h + z * (c - h)`` with an update gate ``z`` and a candidate ``c``, both
read from the input's own row and the last state.  Documents are packed whole into lanes; the state is carried
from window to window and emptied where a document starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, WINDOW, LANES = 16, 16, 384
_F = np.float32


@dataclass
class Layout:
    """Head words have the input rows ``0..head-1``, tail classes the next ``tail``, and the last row is the start.

    ``bounds`` cuts the head words into classes; tail class ``k`` is the class ``len(bounds) - 1 + k``.
    """

    head: int
    tail: int
    bounds: np.ndarray

    @property
    def head_classes(self) -> int:
        return len(self.bounds) - 1

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail

    @property
    def start(self) -> int:
        return self.head + self.tail

    def class_of(self, rows: np.ndarray) -> np.ndarray:
        head = np.searchsorted(self.bounds, rows, "right") - 1
        return np.where(rows < self.head, head, rows - self.head + self.head_classes)

    def classes_of_rows(self) -> np.ndarray:
        """The class of every input row but the start."""
        return self.class_of(np.arange(self.start)).astype(np.int16)


def new_params(layout: Layout, head_weight: np.ndarray, tail_weight: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output biases start at the classes' and words' frequencies."""
    g = np.random.default_rng(seed)
    by_class = np.concatenate((np.add.reduceat(head_weight, layout.bounds[:-1]) if layout.head else np.empty(0), tail_weight)) + 0.5
    return {
        "E": g.normal(0, 0.1, (layout.start + 1, 2 * hidden)).astype(_F),
        "U": g.normal(0, 0.2, (hidden, 2 * hidden)).astype(_F),
        "W": np.zeros((hidden, layout.classes), _F),
        "b": np.log(by_class / by_class.sum()).astype(_F),
        "V": np.zeros((hidden, layout.head), _F),
        "v": np.log(head_weight + 0.5).astype(_F),
    }


def pack(lengths: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane of each document, place of its first token in the lane, length of each lane), long lanes first."""
    order = np.argsort(-lengths, kind="stable")
    lanes = max(1, min(lanes, len(lengths)))
    fill = np.zeros(lanes, np.int64)
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for lo in range(0, len(order), lanes):  # the longest of the rest go to the emptiest lanes
        some = order[lo : lo + lanes]
        free = np.argsort(fill, kind="stable")[: len(some)]
        lane[some], at[some] = free, fill[free]
        fill[free] += lengths[some]
    rank = np.argsort(-fill, kind="stable")
    back = np.empty(lanes, np.int64)
    back[rank] = np.arange(lanes)
    return back[lane], at, fill[rank]


class Pass:
    """One pass over documents ``rows[off[i]:off[i+1]]`` of input rows, window by window."""

    def __init__(self, rows: np.ndarray, off: np.ndarray, layout: Layout, lanes: int = LANES):
        n = np.diff(off)
        lane, at, self.fill = pack(n, lanes)
        width = int(self.fill[0]) if len(self.fill) else 0
        self.grid = np.zeros((width, len(self.fill)), np.int32)
        self.first = np.zeros((width, len(self.fill)), bool)
        k = np.arange(len(rows)) - np.repeat(off[:-1], n)
        self.place = (np.repeat(at, n) + k, np.repeat(lane, n))
        self.grid[self.place] = rows
        self.first[at[n > 0], lane[n > 0]] = True
        self.layout = layout

    def windows(self) -> Iterator[tuple[int, int, int]]:
        """(first step, end, lanes that have a token in it)."""
        for t in range(0, len(self.grid), WINDOW):
            yield t, min(t + WINDOW, len(self.grid)), int(np.searchsorted(-self.fill, -t, "left"))


def _forward(p: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """States before and after every step, gates and candidates; ``keep`` is 0 where a document starts."""
    steps, lanes = x.shape
    d = h.shape[1]
    before, after, zs, cs = (np.empty((steps, lanes, d), _F) for _ in range(4))
    # the logistic gate is read off the same tanh as the candidate: s(a) = (1 + tanh(a / 2)) / 2
    scale = np.concatenate((np.full(d, 0.5, _F), np.ones(d, _F)))
    inp, u = p["E"][x] * scale, p["U"] * scale
    for t in range(steps):
        h = np.multiply(h, keep[t], out=before[t])
        a = h @ u
        a += inp[t]
        np.tanh(a, out=a)
        z, c = zs[t], cs[t]
        np.multiply(a[:, :d], 0.5, out=z)
        z += 0.5
        c[:] = a[:, d:]
        h = np.subtract(c, h, out=after[t])
        h *= z
        h += before[t]
    return before, after, zs, cs


def _exp_sum(x: np.ndarray) -> np.ndarray:
    """Exponentials in place of the scores, which training keeps small; returns the sums by row."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _soft(x: np.ndarray) -> np.ndarray:
    """Softmax by row, in place of the scores."""
    s = _exp_sum(x)
    x /= s[:, None]
    return x


def _with_one(s: np.ndarray) -> np.ndarray:
    """States with a constant, so that biases are a row of the weights."""
    out = np.ones((len(s), s.shape[1] + 1), s.dtype)
    out[:, :-1] = s
    return out


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, list[int]]:
    """(order that sorts tokens by class, where each of the first ``classes`` begins in it, and the last one's end)."""
    order = np.argsort(cls, kind="stable")
    return order, np.searchsorted(cls[order], np.arange(classes + 1)).tolist()


def log_likelihood(p: dict, rows: np.ndarray, off: np.ndarray, layout: Layout) -> np.ndarray:
    """Natural log of each token's class probability, and for head words of the word's in its class."""
    run = Pass(rows, off, layout)
    out = np.zeros(run.grid.shape, _F)
    h = np.zeros((run.grid.shape[1], p["U"].shape[0]), _F)
    last = np.full(run.grid.shape[1], layout.start, np.int32)
    class_of, bounds = layout.classes_of_rows(), layout.bounds.tolist()
    w = np.vstack((p["W"], p["b"]))
    inside = [np.ascontiguousarray(np.vstack((p["V"][:, a:b], p["v"][a:b] - p["v"][a:b].max()))) for a, b in zip(bounds, bounds[1:])]
    for t, end, lanes in run.windows():
        y = run.grid[t:end, :lanes]
        first = run.first[t:end, :lanes]
        x = np.where(first, layout.start, np.concatenate((last[None, :lanes], y[:-1])))
        _, after, _, _ = _forward(p, x, (~first)[:, :, None].astype(_F), h[:lanes])
        h[:lanes], last[:lanes] = after[-1], y[-1]
        word = y.ravel()
        order, ends = _by_class(class_of[word], layout.head_classes)
        word = word[order]
        s = _with_one(after.reshape(-1, after.shape[2])[order])
        score = s @ w
        ll = score[np.arange(len(word)), class_of[word]]
        whole = _exp_sum(score)
        for k in range(layout.head_classes):
            a, b = ends[k], ends[k + 1]
            if a < b and bounds[k + 1] - bounds[k] > 1:
                inner = s[a:b] @ inside[k]
                ll[a:b] += inner[np.arange(b - a), word[a:b] - bounds[k]]
                whole[a:b] *= _exp_sum(inner)
        ll -= np.log(whole)
        back = np.empty(len(word), _F)
        back[order] = ll
        out[t:end, :lanes] = back.reshape(y.shape)
    return out[run.place]


class Trainer:
    """Adagrad, with a gradient in every window.

    Input rows are changed at once; the other weights when the windows since the last change have half of a full one's tokens.
    """

    def __init__(self, params: dict[str, np.ndarray], layout: Layout, rate: float = 0.05):
        self.p = {k: v.copy() for k, v in params.items()}
        self.g2 = {k: np.full_like(v, 1e-9) for k, v in params.items()}
        self.layout, self.rate, self.tokens, self.full = layout, rate, 0, 256
        self.class_of = layout.classes_of_rows()
        self.waiting: dict[str, np.ndarray] = {}
        self.waited = 0

    def _step(self, name: str, grad: np.ndarray, where: object = slice(None)) -> None:
        g2 = self.g2[name][where] + grad * grad
        self.g2[name][where] = g2
        self.p[name][where] -= self.rate * grad / np.sqrt(g2)

    def learn(self, rows: np.ndarray, off: np.ndarray, lanes: int = LANES) -> None:
        run, p, lay = Pass(rows, off, self.layout, lanes), self.p, self.layout
        self.full = max(256, lanes * WINDOW)  # tokens of a full window: those of a thin one, where few long texts are left, weigh no more than others
        h = np.zeros((run.grid.shape[1], p["U"].shape[0]), _F)
        last = np.full(run.grid.shape[1], lay.start, np.int32)
        for t, end, n in run.windows():
            y, first = run.grid[t:end, :n], run.first[t:end, :n]
            x = np.where(first, lay.start, np.concatenate((last[None, :n], y[:-1])))
            keep = (~first)[:, :, None].astype(_F)
            before, after, z, c = _forward(p, x, keep, h[:n])
            real = (np.arange(t, end)[:, None] < run.fill[None, :n]).ravel()
            self._backward(x, y, keep, before, after, z, c, real)
            h[:n], last[:n] = after[-1], y[-1]
            self.tokens += int(real.sum())
        self.settle()

    def _backward(self, x, y, keep, before, after, z, c, real) -> None:
        p, lay = self.p, self.layout
        steps, n, d = after.shape
        cls = self.class_of[y.ravel()]
        cls[~real] = lay.classes  # what is no token comes last
        order, ends = _by_class(cls, lay.head_classes)
        order = order[: int(real.sum())]
        word, cls = y.ravel()[order], cls[order]
        s = _with_one(after.reshape(-1, d)[order])
        scale = _F(1 / self.full)
        prob = s @ np.vstack((p["W"], p["b"]))
        _soft(prob)
        prob[np.arange(len(word)), cls] -= 1
        prob *= scale
        back = prob @ p["W"].T
        gw = s.T @ prob
        gv = np.zeros((d + 1, lay.head), p["V"].dtype)
        for k in range(lay.head_classes):
            a, b = ends[k], ends[k + 1]
            lo, hi = lay.bounds[k], lay.bounds[k + 1]
            if a < b and hi - lo > 1:
                v = p["V"][:, lo:hi]
                inner = s[a:b] @ np.vstack((v, p["v"][lo:hi] - p["v"][lo:hi].max()))
                _soft(inner)
                inner[np.arange(b - a), word[a:b] - lo] -= 1
                inner *= scale
                back[a:b] += inner @ v.T
                gv[:, lo:hi] = s[a:b].T @ inner
        ds = np.zeros((steps * n, d), back.dtype)
        ds[order] = back
        ds = ds.reshape(steps, n, d)
        da = np.empty((steps, n, 2 * d), _F)
        dz, dc = (c - before) * z * (1 - z), z * (1 - c * c)
        stay = (1 - z) * keep
        ut = np.ascontiguousarray(p["U"].T)
        dh = np.zeros((n, d), _F)
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            np.multiply(dh, dz[t], out=da[t, :, :d])
            np.multiply(dh, dc[t], out=da[t, :, d:])
            dh *= stay[t]
            dh += (da[t] @ ut) * keep[t]
        flat = da.reshape(-1, 2 * d)
        rows = x.ravel()
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
        self._step("E", np.add.reduceat(flat[order], at, axis=0), rows[order][at])
        for name, grad in (("U", before.reshape(-1, d).T @ flat), ("W", gw[:-1]), ("b", gw[-1]), ("V", gv[:-1]), ("v", gv[-1])):
            self.waiting[name] = self.waiting[name] + grad if name in self.waiting else grad
        self.waited += len(word)
        if 2 * self.waited >= self.full:
            self.settle()

    def settle(self) -> None:
        """Changes the weights by the gradients that still wait."""
        for name, grad in self.waiting.items():
            self._step(name, np.clip(grad, -1, 1))
        self.waiting, self.waited = {}, 0
