"""Small deterministic weighted transducers, over token classes or over letters, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Mapping
from dataclasses import dataclass, field

Mark = frozenset
#: The letter that ends a word.
END = " "


@dataclass
class Transducer:
    """Reads one symbol at a time; an arc leads to a state, adds marks to the symbol and a weight to the path.

    ``arcs[state][symbol] = (state, marks, weight)``; the symbol ``None`` stands for all others.
    """

    start: Hashable
    arcs: dict[Hashable, dict[str | None, tuple[Hashable, Mark, float]]] = field(default_factory=dict)

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, Mark, float]:
        row = self.arcs[state]
        return row[symbol] if symbol in row else row[None]


def within(trigger: str, reach: int, marked: tuple[str, ...], mark: str, weight: float = 0.0) -> Transducer:
    """Marks classes ``marked`` that come at most ``reach`` tokens after a ``trigger``; the state counts what is left."""
    t, none = Transducer(0), frozenset()
    for left in range(reach + 1):
        after = max(0, left - 1)
        t.arcs[left] = {None: (after, none, 0.0), trigger: (reach, none, 0.0)}
        for symbol in marked:
            t.arcs[left][symbol] = (after, frozenset({mark}) if left else none, weight if left else 0.0)
    return t


def between(symbol: str, marked: tuple[str, ...], mark: str, weight: float = 0.0) -> Transducer:
    """Marks classes ``marked`` that stand between two of ``symbol`` (quotation marks)."""
    t, none = Transducer(0), frozenset()
    for inside in (0, 1):
        t.arcs[inside] = {None: (inside, none, 0.0), symbol: (1 - inside, none, 0.0)}
        for s in marked:
            t.arcs[inside][s] = (inside, frozenset({mark}) if inside else none, weight if inside else 0.0)
    return t


def trie(patterns: Mapping[str, tuple[float, bool]], mark: str) -> Transducer:
    """Reads a word letter by letter, then ``END``: the path's weight is that of the longest pattern it begins with.

    ``patterns`` map a word or word beginning to (weight, whole word?).  Only the arc that completes a pattern has marks and a weight, what
    the pattern adds to the longest one before it on the path; the state ``None`` reads the rest of a word.
    """
    none = frozenset()
    t = Transducer("", {"": {}, None: {None: (None, none, 0.0)}})
    best: dict[str, float] = {}
    for p in sorted(patterns, key=len):
        weight, whole = patterns[p]
        for k in range(len(p)):
            t.arcs.setdefault(p[: k + 1], {})
            t.arcs[p[:k]].setdefault(p[k], (p[: k + 1], none, 0.0))
        before = next((best[p[:k]] for k in range(len(p) - (not whole), 0, -1) if p[:k] in best), 0.0)
        if whole:
            t.arcs[p][END] = (None, frozenset({mark}), weight - before)
        else:
            t.arcs[p[:-1]][p[-1]] = (p, frozenset({mark}), weight - before)
            best[p] = weight
    for row in t.arcs.values():
        row.setdefault(None, (None, none, 0.0))
    return t


def read(t: Transducer, symbols: Iterable[str]) -> tuple[Mark, float]:
    """All marks and the weight of the path that reads ``symbols``."""
    state, marks, weight = t.start, frozenset(), 0.0
    for s in symbols:
        state, more, w = t.step(state, s)
        marks, weight = marks | more, weight + w
        if state is None:
            break
    return marks, weight


def compose(a: Transducer, b: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """Both at once: states are pairs, marks are united, weights added; only reachable states are kept."""
    out = Transducer((a.start, b.start))
    todo = [out.start]
    while todo:
        state = todo.pop()
        if state in out.arcs:
            continue
        row: dict[str | None, tuple[Hashable, Mark, float]] = {}
        for s in (*symbols, None):
            x, y = (m.arcs[q].get(s, m.arcs[q][None]) for m, q in ((a, state[0]), (b, state[1])))
            row[s] = ((x[0], y[0]), x[1] | y[1], x[2] + y[2])
            todo.append(row[s][0])
        out.arcs[state] = row
    return out


def compact(t: Transducer, name: Callable[[Mark], int]) -> tuple[list[dict[str | None, tuple[int, int, float]]], int]:
    """States numbered, marks named by an integer: (rows of symbol -> (state, name, weight), start)."""
    number = {s: i for i, s in enumerate(t.arcs)}
    return [{k: (number[q], name(m), w) for k, (q, m, w) in row.items()} for row in t.arcs.values()], number[t.start]
