from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loresift import cli
from loresift.operators import pairs, render

EVENTS = [
    (0, "run_started", None, {}, "/r", None),
    (1, "tool_called", "Bash", {"command": 'cd sub && loresift context "where is the parser" --tag py'}, "/r", "see `src/a.py` and ref: docs/x.md#y ·"),
    (2, "tool_called", "Read", {"file_path": "/r/sub/src/a.py"}, None, None),
    (3, "tool_called", "Grep", {"path": "/r/sub/.claude/worktrees/w1/src/b.py"}, None, None),
    (4, "note", None, {}, None, None),
    (5, "tool_called", "Edit", {"file_path": "/r/sub/node_modules/c.js"}, None, None),
    (6, "tool_called", "Bash", {"command": "loresift context 'short'"}, None, None),
    (7, "tool_called", "Bash", {"command": 'loresift context "where is the parser"'}, None, None),
    (8, "tool_called", "Write", {"file_path": "/elsewhere/d.py"}, None, None),
]


def events(spark):
    return spark.createDataFrame([("run", *e) for e in EVENTS], "run_id string, seq int, event string, tool_name string, tool_input map<string,string>, cwd string, result string")


def test_pairs(spark):
    (p,) = pairs.extract(events(spark)).collect()
    assert (p["query"], p["cwd"], p["turn"], p["gold_files"], p["tag"]) == ("where is the parser", "/r/sub", 1, ["src/a.py", "src/b.py"], "py")
    assert (p["followed"], p["followed_soft"], p["n_output_refs"]) == (True, True, 2)
    assert pairs.extract(events(spark), window=1).first()["gold_files"] == ["src/a.py"]
    assert pairs.extract(events(spark), cwd="/r").count() == 0
    assert pairs.follow_rate(pairs.extract(events(spark))).first()["rate"] == 1.0


@pytest.mark.parametrize(("path", "want"), [("/a/b/../c", "/a/c"), ("/a/./b//c/", "/a/b/c"), ("/a/b/c/../../d", "/a/d"), ("/a/..", "/")])
def test_normalised(spark, path, want):
    assert spark.range(1).select(pairs.normalised(F.lit(path)).alias("x")).first()["x"] == want


def test_commands(spark, tmp_path, capsys):
    run = lambda *a: (cli.main(["--store", str(tmp_path), *a]), capsys.readouterr().out)
    _, first = run("remember", "Use postgres for storage", "--kind", "rule", "--tag", "DB")
    run("remember", "Redis caches sessions")
    assert "Use postgres" in run("recall", "rds", "-n", "1")[1]
    text = run("context", "postgres storage")[1]
    assert text.index("## Constraints") < text.index("Use postgres") < text.index("## Facts")
    assert "Use postgres" in run("list", "--tag", "db")[1] and "live: 2" in run("stats")[1]
    assert "- Use postgres for storage" in run("hot")[1]
    assert run("forget", first.strip())[0] == 0 and "postgres" not in run("list")[1]
    assert run("forget", "nope")[0] == 1
    assert run("forget", first.strip(), "--revive")[0] == 0 and "postgres" in run("list")[1]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.tf").write_text('module "vpc" {}\n')
    run("index", str(tmp_path / "src"))
    assert "module vpc" in run("recall", "vpc module", "-n", "1")[1]
    assert '"verified"' in run("verify", str(tmp_path / "src"))[1]
    run("review")


def test_rendering():
    e = {"id": "1", "kind": "rule", "ts": "2024-01-02T00:00:00", "text": "T", "source": "manual", "source_ref": "a.md", "source_lines": [1, 2], "tags": ["x"], "score": 1.23456, "drifted_at": "2024-02-03T"}
    assert "ref: a.md:1-2 · DRIFTED" in render.context("q", [e]) and "score: 1.2346" in render.recall([e])
    assert render.unseen([], []) == "" and "nearby tags: `t` (2)" in render.unseen([{"source_ref": "a#b"}], [("t", 2)], (1, 2))
    assert "No relevant entries" in render.context("q", [])
    row = {"k": 5, "n": 3, "hit_rate": 0.5, "mean_recall": 0.25}
    assert "Hit@5: 50.0% strict / 50.0% soft" in render.report([row], [row], (0.5, 0.6), (1.0, 2))
