from __future__ import annotations

import io
import json

import pytest

from loresift import cli
from loresift.streaming import streams, watching


@pytest.fixture
def run(tmp_path, capsys):
    return lambda *a, **k: (cli.main(["--store", str(tmp_path / "store"), *a], **k), capsys.readouterr().out)


def test_hook_speaks_now_and_then(run, tmp_path, monkeypatch):
    run("remember", "Use postgres for the storage of sessions")
    log = tmp_path / "log.jsonl"
    payload = {"prompt": "how are sessions stored in postgres here", "transcript_path": str(log)}
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(payload)))
    out = run("hook", "inject")[1]
    assert cli.HOOK_MARK in json.loads(out)["hookSpecificOutput"]["additionalContext"]
    log.write_text(json.dumps({"type": "assistant", "text": cli.HOOK_MARK}) + "\n" + '{"type": "user"}\n' * 4 + "broken\n")
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(payload)))
    assert run("hook", "inject") == (0, "")
    monkeypatch.setattr("sys.stdin", io.StringIO("no json"))
    assert run("hook", "inject") == (0, "")


def test_watching_queues_and_applies(spark, tmp_path):
    tree, listed, seen = tmp_path / "tree", tmp_path / "list", []
    tree.mkdir()
    (tree / "a.md").write_text("one")
    listed.write_text(f"{tree}\n{tmp_path / 'gone'}\n")
    fail = [False]

    def apply(root, changes):
        if fail[0]:
            raise RuntimeError("later")
        seen.append(sorted((r["path"], r["op"]) for r in changes.collect()))

    w = watching.Watcher(spark, listed, tmp_path / "state", apply)
    w.step()
    assert seen == [] and str(tmp_path / "gone") in w.failed
    (tree / "b.md").write_text("two")
    (tree / ".hidden").write_text("x")
    w.step()
    assert seen == [[("b.md", "created")]]
    (tree / "a.md").unlink()
    fail[0] = True
    w.step()
    assert str(tree) in watching.heartbeat(tmp_path / "state")["failed"]
    fail[0] = False
    assert watching.Watcher(spark, listed, tmp_path / "state", apply).flush() == 1 and seen[-1] == [("a.md", "deleted")]
    listed.write_text("")
    assert w.step() == {}


def test_kept_state_survives_a_restart(spark, tmp_path):
    apply = streams.keep_last(str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "path string, seq int, op string")
    apply(rows(("a", 1, "created"), ("b", 2, "created")), 0)
    streams.keep_last(str(tmp_path))(rows(("a", 3, "deleted")), 1)
    streams.keep_last(str(tmp_path))(rows(("a", 3, "deleted")), 1)
    assert sorted((r["path"], r["op"]) for r in streams.kept_last(spark, str(tmp_path)).collect()) == [("a", "deleted"), ("b", "created")]
