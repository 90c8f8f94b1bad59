"""Toxicity by a weighted finite-state pattern grammar (operator 5).

Five kinds of weighted transducers work together.  The insult transducer reads words letter by letter: a trie of words and word
beginnings learned from labels, whose path weight is the longest match's log-odds.  The others read the token classes of a
clause and mark its insults and verbs of violence: as threats after a word of intent, as aimed at a target, as negated, and
as reported (after a verb of saying, or in quotation marks).  They are composed to one machine that reads the clause forwards, and one that
reads it backwards, for targets and verbs of saying that come later.  A hit's path weight is what the trie and both machines give it
together; a clause has the positive weights of its hits, and a document's score is a logistic function of its
clauses' weights and of how many hits they have of each class and kind.  No word counts outside of its clause.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import cut, discard, need, session, small_batches, unit_of
from loresift.llm.fst import END, Transducer, between, compact, compose, read, trie, within

# Fixed word lists (English, German, French, Spanish).
TARGET = "you your yours yourself he she him her they them du dich dir ihr euch er sie tu toi te vous il elle ils elles eres usted ustedes tú ti él ella ellos ellas".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't without nicht kein keine keinen nie niemals ohne ne pas jamais sans ni nunca jamás sin".split()
REPORTED = "said says say saying told called calls wrote writes quoted claimed according sagte sagt nannte schrieb laut dit disait appelé écrit selon dijo dice llamó escribió según".split()
INTENT = "will would going gonna should must want wanna werde wird soll muss will vais va veux dois voy va quiero debe".split()
VIOLENCE = "kill killed murder stab shoot hurt töten umbringen erschießen tuer frapper égorger matar golpear disparar".split()
QUOTES = "\"“”„«»"

#: Labelled rows used to fit; the bound of the one sample that is taken.
MAX_LABELLED = 12_000
SHORTEST, LONGEST = 4, 7
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
CLAUSE_ENDS = ".!?;\n"
HITS = ("I1", "I2", "I3", "V")
SYMBOLS = (*HITS, "P", "N", "R", "Q", "M")
KINDS = ("plain", "targeted", "negated", "reported", "threat")
#: Arc weights of the marks.
WEIGHTS = {"targeted": 0.8, "negated": -2.5, "reported": -1.5, "threat": 1.5}
#: Path weight of a verb of violence before any mark.
VIOLENT = 0.5
#: What a document's clauses yield: log1p counts of hits by class and kind, then the clauses' summed path weight, its share of the text, the heaviest clause and a constant.
N_FEATURES = len(HITS) * len(KINDS) + 4
PRIOR = np.array([0.4, 0.5, 0.1, 0.1, 0.5, 0.9, 1.0, 0.3, 0.3, 1.0, 2.0, 2.2, 0.8, 0.8, 2.2, 0.3, 0.8, 0.0, 0.0, 1.2, 0.5, 0.5, 0.2, -3.0])


def _kind(marks: frozenset) -> int:
    for mark in ("negated", "reported", "threat", "targeted"):
        if mark in marks:
            return KINDS.index(mark)
    return 0


def _product(parts: list[Transducer]) -> Transducer:
    out = parts[0]
    for other in parts[1:]:
        out = compose(out, other, SYMBOLS)
    return out


def forwards() -> Transducer:
    """Marks of what stands before a hit, and of quotation marks around it."""
    return _product([within("P", 4, HITS, "targeted", WEIGHTS["targeted"]), within("M", 5, ("V",), "threat", WEIGHTS["threat"]), within("N", 3, HITS, "negated", WEIGHTS["negated"]), within("R", 6, HITS, "reported", WEIGHTS["reported"]), between("Q", HITS, "reported", WEIGHTS["reported"])])


def backwards() -> Transducer:
    """Marks of what comes after a hit; it reads a clause from its end."""
    return _product([within("P", 3, HITS, "targeted", WEIGHTS["targeted"]), within("R", 4, HITS, "reported", WEIGHTS["reported"])])


@dataclass
class Model:
    """``patterns``: word or word beginning -> (weight, whole word?); ``beta``: weights of the features."""

    patterns: dict[str, tuple[float, bool]]
    beta: np.ndarray


class Scorer:
    """Built once in a worker: the trie of patterns, the places where its words may begin, and the composed machines."""

    def __init__(self, model: Model):
        self.beta = model.beta
        self.classes = {w: c for c, words in (("M", INTENT), ("P", TARGET), ("N", NEGATION), ("R", REPORTED)) for w in words} | dict.fromkeys(QUOTES, "Q")
        self.insults = trie(model.patterns, "insult")
        self.violence = trie({w: (VIOLENT, True) for w in VIOLENCE}, "violence")
        self.auto = ahocorasick.Automaton()
        for p in {*model.patterns, *VIOLENCE}:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        # marks are named by their kind; what a pair of them comes to is looked up
        sets: list[frozenset] = []

        def name(marks: frozenset) -> int:
            if marks not in sets:
                sets.append(marks)
            return sets.index(marks)

        self.ahead, self.first = compact(forwards(), name)
        self.back, self.last = compact(backwards(), name)
        self.kind = [[_kind(x | y) for y in sets] for x in sets]
        self.seen: dict[str, tuple[str | None, float]] = {}

    def of_word(self, word: str) -> tuple[str | None, float]:
        """The class of a word and its path weight in the trie."""
        got = self.seen.get(word)
        if got is None:
            marks, weight = read(self.insults, [*word, END])
            if marks:
                got = ("I3" if weight >= 4 else "I2" if weight >= 2.5 else "I1", weight)
            else:
                marks, weight = read(self.violence, [*word, END])
                got = ("V", weight) if marks else (self.classes.get(word), 0.0)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def clause(self, tokens: list[str]) -> list[tuple[str, int, float]]:
        """(class, kind, path weight) of the hits of a clause, in its order."""
        read_as = [self.of_word(t) for t in tokens]
        after, state = [], self.last
        for symbol, _ in reversed(read_as):
            row = self.back[state]
            state, name, weight = row[symbol] if symbol in row else row[None]
            after.append((name, weight))
        out, state = [], self.first
        for (symbol, own), (later, gain) in zip(read_as, reversed(after), strict=True):
            row = self.ahead[state]
            state, name, weight = row[symbol] if symbol in row else row[None]
            if symbol in _HIT_AT:
                out.append((symbol, self.kind[name][later], own + weight + gain))
        return out

    def clauses(self, low: str) -> Iterator[list[str]]:
        """The tokens of every clause in which a pattern may begin a word, each clause once and whole."""
        at = sorted({e - n + 1 for e, n in self.auto.iter(low)}) if len(self.auto) else []
        ends, done = dict.fromkeys(CLAUSE_ENDS, -1), 0
        for pos in at:
            if pos < done or (pos and low[pos - 1].isalpha()):
                continue
            start = max(done, *(low.rfind(c, done, pos) + 1 for c in CLAUSE_ENDS))
            for c, e in ends.items():
                if e < pos:
                    e = low.find(c, pos)
                    ends[c] = len(low) if e < 0 else e
            done = min(ends.values())
            yield _TOKEN.findall(low, start, done)

    def features(self, text: str) -> np.ndarray:
        f = np.zeros(N_FEATURES)
        f[-1] = 1.0
        if not text:
            return f
        total = most = 0.0
        for tokens in self.clauses(text.lower()):
            whole = 0.0
            for symbol, kind, weight in self.clause(tokens):
                f[_HIT_AT[symbol] + kind] += 1
                whole += max(0.0, weight)
            total, most = total + whole, max(most, whole)
        n = len(HITS) * len(KINDS)
        f[:n] = np.log1p(f[:n])
        f[n] = np.log1p(total)
        f[n + 1] = min(3.0, 100.0 * total / (len(text) / 6 + 20))
        f[n + 2] = np.log1p(most)
        return f

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.features(text) @ self.beta, -30, 30))))


_HIT_AT = {h: i * len(KINDS) for i, h in enumerate(HITS)}


def _vocabulary(text: str) -> set[str]:
    """Words (ended by a space) and word beginnings of a text."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + " ")
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(w[:k])
    return out


def learn_patterns(labelled: DataFrame, z: float = 1.5, least: float = 0.5) -> dict[str, tuple[float, bool]]:
    """Words and word beginnings whose presence speaks for label 1, with log-odds weights.

    A pattern counts if at least three texts of label 1 have it and its log-odds less ``z`` standard errors is at least
    ``least``; one that adds nothing to a shorter one is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out():
            keys = list(count)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())], ["pattern", "toxic", "n"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update((p, toxic) for p in _vocabulary(text or ""))
                if len(count) > 400_000:
                    yield out()
                    count.clear()
        yield out()

    classes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = classes.get(1, 0), classes.get(0, 0)
    if not pos or not neg:
        return {}
    g = labelled.select("text", "toxic").mapInArrow(run, "pattern string, toxic int, n long").groupBy("pattern")
    g = g.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    sure = odds - z * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    rows = g.select("pattern", "a", "b", odds.alias("w"), sure.alias("sure")).where(F.col("sure") >= least).collect()  # no more than the bounded sample has words
    found = {r["pattern"]: (r["w"], r["a"], r["b"]) for r in rows}
    kept: dict[str, tuple[float, bool]] = {}
    for p in sorted(found, key=lambda x: (len(x.strip()), x)):
        w, a, b = found[p]
        whole, stem = p.endswith(" "), p.strip()
        parents = [kept[stem[:k]] for k in range(SHORTEST, len(stem) + whole) if stem[:k] in kept and not kept[stem[:k]][1]]
        if parents and w <= parents[-1][0] + 0.5:
            continue
        kept[stem] = (w, whole)
    return kept


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 8.0, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, shrunk towards ``prior``."""
    beta = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + ridge * (beta - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        d = np.linalg.solve(h, g)
        beta = beta - np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-6:
            break
    return beta


def fit(labelled: DataFrame) -> Model:
    """Learns from ``labelled(doc_id, text, toxic)``, which ``labelled_sample`` bounds.

    Rows whose label is neither 0 nor 1 are left out; null texts count as empty.  Without rows of both labels the priors stay.
    The sample is written once, as it is read several times.
    """
    small_batches(session(labelled))
    labelled = cut(need(labelled, ["doc_id", "text", "toxic"]).where("toxic in (0, 1)"))
    patterns = learn_patterns(labelled)
    # weights of the grammar come from rows that didn't make the patterns they are scored with
    half = unit_of("doc_id", "toxic").cast("double") < 0.5
    halves = [learn_patterns(labelled.where(half)), learn_patterns(labelled.where(~half))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(Model(p, PRIOR)) for p in halves]
        for b in batches:
            x = [scorers[int(first)].features(t or "").tolist() for t, first in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    rows = labelled.select("text", "toxic", half.alias("first")).mapInArrow(run, "x array<double>, y int").toPandas()  # bounded as the sample is
    discard(labelled)
    if not len(rows) or not patterns:
        return Model(patterns, PRIOR)
    return Model(patterns, _fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(float), PRIOR))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most about ``max_labelled`` labelled documents, by a hash of the id.

    A document with several labels counts as toxic if one is 1; null labels are left out.
    """
    ids = need(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = ids.count()
    if n > max_labelled:
        ids = ids.where(unit_of("doc_id") < max_labelled / n)
    return need(docs, ["doc_id", "text"]).join(F.broadcast(ids), "doc_id")  # bounded by max_labelled


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row: the probability of label 1, of whole texts.

    Null and empty texts get the score of a text without hits; repeated rows are scored each; null ids stay.
    """
    spark = session(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t or "") for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return need(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all of their columns.

    Null and empty texts have the score of a text without hits, which is below 0.3 in any fitted model, and stay; null
    ids are judged by their texts like all others; repeated rows share their fate.  Very long texts are read whole.
    """
    small_batches(session(docs))
    shared = session(docs).sparkContext.broadcast(model)  # bounded by the words of the bounded sample
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
