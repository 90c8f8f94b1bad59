"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Token counts are added up by cell (source, language, topic).  Raking multiplies the cells' weights until
every marginal has its target share; a document is then kept with a probability proportional to its cell's
calibrated weight for each token that is there.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import SPACE, cut, session, unit_of

AXES = ("source", "lang", "topic")
ROUNDS = 20
#: Shares that are off by more than this after the last round are reported.
TOLERANCE = 1e-3
#: Cells raked in the driver; more are raked by window sums on the executors.
MAX_CELLS = 200_000
#: Topic rules in order; the first that matches the text names the topic.
TOPICS = (
    ("legal", "(?i)licen[sc]ed under|copyright|all rights reserved"),
    ("contact", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    ("shout", "[A-Z]{2,}!!"),
    ("list", "(^|\\n)[|*-] ?[^\\n]"),
)
#: Targets are the observed shares to this power, so that small groups gain.
TEMPER = 0.7


def n_tokens():
    return F.regexp_count("text", F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def topic_of(text):
    out = None
    for name, rule in TOPICS:
        out = F.when(text.rlike(rule), name) if out is None else out.when(text.rlike(rule), name)
    return out.otherwise("prose")


def described(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens)``; null texts count as empty, null groups as ``''``."""
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), n_tokens().alias("n_tokens"))


def tempered(totals: Mapping[str, float], power: float = TEMPER) -> dict[str, float]:
    """Target shares: observed token shares to ``power``, made to sum to 1; empty groups get none."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells after ``rounds`` passes over the axes; a group without weight is left alone."""
    w = cells.astype(float) / max(cells.sum(), 1)
    for _ in range(rounds):
        for code, target in zip(axes, targets, strict=True):
            have = np.bincount(code, weights=w, minlength=len(target))
            w = w * np.where(have > 0, target / np.where(have > 0, have, 1), 1.0)[code]
    return w


def misfit(w: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """By how much the share of any group is off its target, at most."""
    whole = max(w.sum(), 1e-300)
    return max((float(np.abs(np.bincount(code, weights=w, minlength=len(t)) / whole - t).max()) for code, t in zip(axes, targets, strict=True) if len(t)), default=0.0)


def _rake_wide(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same on DataFrames, for more cells than the driver should hold."""
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for i in range(rounds):
        for a in AXES:
            have = w.groupBy(a).agg(F.sum("w").alias("have"))
            w = w.join(have.join(targets[a], a, "left").na.fill(0.0, ["share"]), a).withColumn("w", F.when(F.col("have") > 0, F.col("w") * F.col("share") / F.col("have")).otherwise(0.0)).drop("have", "share")
        w = cut(w)
    return w


def calibrated(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, max_cells: int = MAX_CELLS, power: float = TEMPER) -> DataFrame:
    """``(source, lang, topic, prob)``: the keeping probability of every cell of ``cells(source, lang, topic, tokens)``.

    Targets default to tempered shares.  A group missing from given targets gets the share 0; cells without
    tokens have probability 1, as they don't change any share.  The largest probability is 1.
    """
    spark, cells = session(cells), cut(cells)
    if cells.count() > max_cells:
        wide = {}
        for a in AXES:
            total = cells.groupBy(a).agg(F.sum("tokens").alias("t")).where("t > 0")
            if targets and a in targets:
                wide[a] = spark.createDataFrame([(k, float(v)) for k, v in targets[a].items()] or [("", 0.0)], f"{a} string, share double")
            else:
                raised = total.withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
                wide[a] = raised.crossJoin(F.broadcast(raised.agg(F.sum("p").alias("whole")))).select(a, (F.col("p") / F.col("whole")).alias("share"))  # one row
        w = _rake_wide(cells.where("tokens > 0"), wide, rounds).withColumn("rate", F.col("w") / F.col("tokens"))
        top = w.agg(F.max("rate").alias("top"))
        w = w.crossJoin(F.broadcast(top)).select(*AXES, (F.col("rate") / F.greatest("top", F.lit(1e-300))).alias("p"))  # one row
        return cells.select(*AXES, "tokens").join(w, list(AXES), "left").select(*AXES, F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(1.0).alias("prob"))
    rows = sorted((r["source"], r["lang"], r["topic"], int(r["tokens"])) for r in cells.collect())
    tokens = np.array([r[3] for r in rows], float)
    codes, shares = [], []
    for k, a in enumerate(AXES):
        names = sorted({r[k] for r in rows})
        place = {n: i for i, n in enumerate(names)}
        code = np.array([place[r[k]] for r in rows], int)
        share = targets[a] if targets and a in targets else tempered(dict(zip(names, np.bincount(code, weights=tokens, minlength=len(names)).tolist(), strict=True)), power)
        codes.append(code)
        shares.append(np.array([share.get(n, 0.0) for n in names]))
    rate = np.zeros(len(rows))
    if len(rows) and tokens.sum():
        w = rake(tokens, codes, shares, rounds)
        if (off := misfit(w, codes, shares)) > TOLERANCE:
            warnings.warn(f"after {rounds} rounds a share is off its target by {off:.4f}: the targets contradict each other, or need more rounds", stacklevel=2)
        rate = np.where(tokens > 0, w / np.where(tokens > 0, tokens, 1), 0)
        rate = rate / max(rate.max(), 1e-300)
    prob = np.where(tokens > 0, rate, 1.0)
    return spark.createDataFrame([(*r[:3], float(p)) for r, p in zip(rows, prob, strict=True)], "source string, lang string, topic string, prob double")


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, prob, kept)`` of every row of ``docs``.

    ``kept`` is decided by a hash of the id, so repeated rows share their fate and a rerun repeats it.
    Null ids count as the empty text; an empty table gives an empty result.
    """
    rows = cut(described(docs))  # small, and read three times
    cells = rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"))
    prob = calibrated(cells, targets)
    joined = rows.join(prob, list(AXES), "left")
    return joined.select("doc_id", *AXES, "n_tokens", F.round("prob", 6).alias("prob"), (unit_of("doc_id") < F.round("prob", 6)).alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, power: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` that the calibrated sampling keeps, with their own columns."""
    cells = described(docs).groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"))
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):  # no clash with columns of the caller
        own += "_"
    prob = calibrated(cells, targets, power=power).select(*[F.col(a).alias(f"{own}_{a}") for a in AXES], F.col("prob").alias(f"{own}_prob"))
    text, same = F.coalesce("text", F.lit("")), []
    keyed = docs.withColumn(f"{own}_of", topic_of(text))
    for a, c in zip(AXES, (F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col(f"{own}_of")), strict=True):
        same.append(c == F.col(f"{own}_{a}"))
    return keyed.join(prob, same[0] & same[1] & same[2]).where(unit_of("doc_id") < F.round(f"{own}_prob", 6)).select(*docs.columns)
