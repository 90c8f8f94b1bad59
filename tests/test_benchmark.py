from __future__ import annotations

import json

import pytest

from loresift.operators import benchmark
from loresift.sources import jsonl


def test_questions_rank_their_own_sessions(spark, tmp_path):
    turns = lambda t: [{"role": "user", "content": t}]
    rows = [
        {"question_id": "a", "question": "postgres backups", "question_type": "x", "answer_session_ids": ["s2", "s3"], "haystack_session_ids": ["s1", "s2", "s3"], "haystack_dates": ["", "", ""], "haystack_sessions": [turns("weather"), turns("postgres backups nightly"), turns("nothing of note")]},
        {"question_id": "b", "question": "postgres", "answer_session_ids": [], "haystack_session_ids": ["s9"], "haystack_dates": [""], "haystack_sessions": [turns("postgres")]},
    ]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    judged = benchmark.judge(jsonl.questions(spark, str(tmp_path / "q.jsonl")), ks=(1, 3)).cache()
    got = {(r["query"], r["k"]): r for r in judged.collect()}
    assert got["a", 1]["recall"] == 0.5 and got["a", 3]["recall"] == 1.0 and got["a", 1]["ndcg"] == 1.0 and got["a", 3]["rr"] == 1.0
    assert got["b", 1]["recall"] == 0 and got["b", 1]["question_type"] == "unknown"
    assert {(r["question_type"], r["k"]): r["recall_strict"] for r in benchmark.summary(judged, "question_type").collect()}["x", 3] == 1.0
    assert benchmark.summary(judged).where("k = 1").first()["recall_any"] == pytest.approx(0.5)
    assert benchmark.wide(judged).count() == 2


def test_questions_are_ranked_as_by_search_and_without_an_exchange(spark, tmp_path):
    import random

    from loresift.operators import bm25
    from loresift.operators.bm25 import SearchParams

    g = random.Random(3)
    words = ["alpha", "beta", "gamma", "running", "the", "été", "s3", "boxes", ""]
    say = lambda n: " ".join(g.choice(words) for _ in range(n))
    rows = []
    for i in range(30):
        n = g.randrange(0, 9)
        sessions = [[{"role": "user", "content": say(g.randrange(0, 12))} for _ in range(g.randrange(0, 3))] for _ in range(n)]
        rows.append({"question_id": f"q{i}", "question": say(4), "answer_session_ids": [f"s{i % 5}"], "haystack_session_ids": [f"s{j}" for j in range(n)], "haystack_dates": [""] * n, "haystack_sessions": sessions})
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    q, p = jsonl.questions(spark, str(tmp_path / "q.jsonl")).cache(), SearchParams(top_n=4)
    corpus = jsonl.question_corpus(q).cache()
    asked = q.selectExpr("question_id corpus", "question_id query", "question text")
    best = bm25.search(corpus.select("corpus", "doc", "pos", "text"), asked, p).join(corpus.select("corpus", "doc", "session_id"), ["corpus", "doc"])
    own = benchmark.ranked(q, p)
    assert {(r["query"], i + 1, s) for r in own.collect() for i, s in enumerate(r["items"])} == {(r["query"], r["rank"], r["session_id"]) for r in best.collect()}
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
