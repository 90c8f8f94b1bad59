from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.functions import aliases, refs
from loresift.functions import text as T
from loresift.operators import bm25, rank
from loresift.operators.bm25 import SearchParams


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "folded"),
    [("categories", "category"), ("classes", "class"), ("boxes", "box"), ("handlers", "handler"), ("running", "run"), ("syncing", "sync"), ("stopped", "stop"), ("synced", "sync"), ("status", "status"), ("class", "class"), ("is", "is"), ("bus", "bus"), ("king", "king"), ("ties", "tie"), ("seeing", "see")],
)
def test_stem(spark, word, folded):
    assert one(spark, word, T.stem) == folded


def test_tokens_split_compound_names_and_drop_stop_words(spark):
    assert one(spark, "The aws_s3_bucket is Syncing, été!", T.tokens) == ["aws", "s3", "bucket", "sync", "été"]
    assert one(spark, None, T.tokens) == [] and one(spark, "", T.tokens) == []


@pytest.mark.parametrize(("word", "is_one"), [("snake_case", True), ("a.b", True), ("AWS", True), ("s3", True), ("CamelCase", True), ("iPhone", False), ("Hello", False), ("word", False), ("A", False), ("", False)])
def test_identifier_shape(spark, word, is_one):
    assert one(spark, word, T.identifier_shape) is is_one


def test_slug_and_condensed(spark):
    assert one(spark, "  **Set-Up** / [API] Notes! ", T.slug) == "set-up-api-notes"
    long = 'Section "A" of `x.md`. Subsections: b.\n\n## A\n\n' + "word " * 100
    got = one(spark, long, T.condensed)
    assert got.startswith('Section "A" of `x.md` — word word') and got.endswith("[…]")
    assert one(spark, "plain text", T.condensed) == "plain text"
    assert one(spark, "x" * 500, lambda c: T.truncated(c, 10)) == "x" * 10 + "\n\n[...truncated...]"


def test_alias_expansion_keeps_order_and_drops_repeats(spark):
    table = {"a": ["b", "c"], "c": ["d", "a"]}
    assert one(spark, "a c A x", lambda q: aliases.expanded(q, table)) == "a b c d x"
    assert aliases.merged({"a": ["b"]}, {"a": ["a", "c", "b"]}) == {"a": ["b", "c"]}


def test_references(spark):
    assert one(spark, "a/s3.md#x", refs.basename) == "s3" and one(spark, ".", refs.basename) == "" and one(spark, ".env", refs.basename) == ".env"
    assert one(spark, None, refs.file_of) == ""
    assert one(spark, "index", lambda s: refs.stable_id(s, F.lit("a/b.md"))) != one(spark, "index", lambda s: refs.stable_id(s, F.lit("a/c.md")))
    assert len(one(spark, "index", lambda s: refs.stable_id(s, F.lit("x")))) == 26


def plain_bm25(docs: dict[int, list[str]], query: list[str], b=0.85, k1=1.5, eps=0.25) -> dict[int, float]:
    n = len(docs)
    avg = sum(map(len, docs.values())) / n
    df = Counter(t for ws in docs.values() for t in set(ws))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {t: v if v >= 0 else eps * mean for t, v in raw.items()}
    out = {}
    for d, ws in docs.items():
        tf = Counter(ws)
        out[d] = round(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ws) / avg)) for t in query if tf[t]), 4)
    return out


CORPUS = {0: "postgres cluster notes", 1: "redis cache cluster cluster", 2: "", 3: "unrelated noise content", 4: "postgres postgres", 5: "the of and"}


@pytest.mark.parametrize("query", ["postgres cluster", "cluster cluster postgres", "nothing here", ""])
def test_bm25_against_plain_python(spark, query):
    docs = spark.createDataFrame([(0, d, d, t) for d, t in CORPUS.items()], "corpus int, doc int, pos int, text string")
    q = spark.createDataFrame([(0, 1, query)], "corpus int, query int, text string")
    got = {r["doc"]: (r["score"], r["rank"]) for r in bm25.search(docs, q, SearchParams(top_n=10)).collect()}
    words = {d: [w for w in re.split(r"[\W_]+", t.lower()) if w and w not in T.STOP_WORDS] for d, t in CORPUS.items()}
    stem = {w: one(spark, w, T.stem) for ws in [*words.values(), query.split()] for w in ws}
    want = plain_bm25({d: [stem[w] for w in ws] for d, ws in words.items()}, [stem[w] for w in query.split()])
    order = sorted(want, key=lambda d: (-want[d], d))
    assert {d: s for d, (s, _) in got.items()} == pytest.approx(want, abs=1e-4)
    assert [d for d, _ in sorted(got.items(), key=lambda x: x[1][1])] == order


def test_boosts_touch_positive_scores_only(spark):
    docs = spark.createDataFrame([(0, 1, "rule", "manual"), (0, 2, "rule", "index")], "corpus int, doc int, kind string, source string")
    scored = spark.createDataFrame([(0, 1, 1, 2.0), (0, 1, 2, -1.0)], "corpus int, query int, doc int, score double")
    assert {r["doc"]: r["score"] for r in bm25.boosted(scored, docs).collect()} == {1: 8.0, 2: -1.0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(0, 10)), min_size=1, max_size=12), st.integers(1, 6), st.sampled_from([0.0, 0.3, 0.7, 1.0]))
def test_closed_form_of_mmr_is_the_greedy_choice(spark, rows, top_k, lam):
    scores = sorted((round(s, 3) for _, s in rows), reverse=True)
    data = [(1, i, s, i + 1, f"f{f}.md#s{i}" if f else None) for i, ((f, _), s) in enumerate(zip(rows, scores, strict=True))]
    pool = spark.createDataFrame(data, "query long, doc long, score double, rank int, source_ref string")
    closed = [r["doc"] for r in rank.mmr(pool, top_k, lam).orderBy("rank").collect()]
    greedy = [r["doc"] for r in rank.mmr_greedy(pool, top_k, lam).orderBy("rank").collect()][:top_k]
    assert closed == greedy


def test_session_moves_seen_down_and_siblings_up(spark):
    pool = spark.createDataFrame([(1, 1, 4.0, 1, "a.md#x"), (1, 2, 3.0, 2, "b.md"), (1, 3, 2.5, 3, "a.md#y"), (1, 4, -1.0, 4, "a.md#x")], "query long, doc long, score double, rank int, source_ref string")
    seen = spark.createDataFrame([(1, "a.md#x")], "query long, source_ref string")
    assert [(r["doc"], r["score"]) for r in rank.session(pool, seen).orderBy("rank").collect()] == [(3, 3.75), (2, 3.0), (1, 1.2), (4, -1.0)]


def test_reranker_failure_keeps_the_ranking(spark):
    pool = spark.createDataFrame([(1, 1, 2.0, 1, "q", "t"), (1, 2, 1.0, 2, "q", "u")], "query long, doc long, score double, rank int, query_text string, text string")

    def broken(q, t):
        raise RuntimeError("no model")

    import pandas as pd

    broken.__annotations__ = {"q": pd.Series, "t": pd.Series, "return": pd.Series}
    with pytest.warns(UserWarning):
        assert rank.rerank_with(pool, broken, 2).columns == pool.columns


def test_low_signal(spark):
    q = spark.createDataFrame([(1, "please review the code changes"), (2, "review code of WafAlb"), (3, "fix bug"), (4, "deploy database cluster now")], "query long, text string")
    assert {r["query"]: r["hits"] for r in rank.low_signal(q).collect()} == {1: "changes, code, review"}


def test_ranking_with_scores_below_zero_against_brute_force(spark):
    """The first documents all score below 0, so the best unscored ones stand behind the corpus's head."""
    docs = spark.createDataFrame([("c", i, i) for i in range(40)], "corpus string, doc long, pos long")
    queries = spark.createDataFrame([("c", q) for q in (1, 2, 3)], "corpus string, query long")
    scores = {1: {i: -1.0 - i for i in range(30)} | {35: 2.0}, 2: {7: 1.0, 3: 0.00001}, 3: {}}
    scored = spark.createDataFrame([("c", q, d, s) for q, x in scores.items() for d, s in x.items()], "corpus string, query long, doc long, score double")
    got = {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in bm25.ranked(docs, queries, scored, 4).collect()}
    want = {}
    for q, x in scores.items():
        for k, (s, d) in enumerate(sorted((-round(x.get(d, 0.0), 4), d) for d in range(40))[:4], 1):
            want[q, k] = (d, -s)
    assert got == want
