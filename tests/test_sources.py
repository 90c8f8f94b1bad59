from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loresift.operators import store
from loresift.sources import config, files, glossary, jsonl
from loresift.sources import parsers as P
from loresift.streaming import streams


def kinds(blocks):
    return [(b.kind, b.name, list(b.labels)) for b in blocks]


def test_terraform():
    text = '# Buckets for logs\n# of all sites\n\nresource "aws_s3_bucket" "logs" {\n}\nmodule "vpc" {}\nvariable "x" {}\nlocals {\n}\n'
    found = P.analyze("a/main.tf", text)
    assert kinds(found.blocks) == [("resource", "logs", ["aws_s3_bucket"]), ("module", "vpc", []), ("variable", "x", []), ("locals", "(block)", [])]
    assert found.header == "Buckets for logs of all sites" and {"aws_s3_bucket", "s3-bucket", "storage", "vpc"} <= found.tags
    assert found.summary == "Resources: aws_s3_bucket, vpc; 4 Terraform blocks total"


def test_python():
    text = '@router.get("/v1/users/{id}")\n@cached\nasync def read(x):\n    """One user.\n\n    More."""\n\nclass User(Document, Generic[T], metaclass=Meta):\n    x = 1\n\ndef test_it():\n    """\n    First line\n    """\n'
    found = P.analyze("x.py", text)
    assert kinds(found.blocks) == [("route", "read", ["GET", "/v1/users/{id}"]), ("class", "User", ["Document", "Generic", "Meta"]), ("function", "test_it", [])]
    assert [b.doc for b in found.blocks] == ["One user.", "", "First line"]
    assert {"get", "api", "users", "v1", "model", "mongodb", "test"} <= found.tags
    assert found.summary == "Python file with 1 route, 1 class, 1 function"


def test_go():
    text = 'package main\n\n// Serves pages.\n// Fast.\ntype PageServer struct {\n}\nfunc (s *PageServer) Run(x int) {\n}\nfunc main() {\n\tr.Get("/v2/x", h)\n\tmux.HandleFunc("/y", g)\n}\n'
    found = P.analyze("m.go", text)
    assert kinds(found.blocks) == [("package", "main", []), ("struct", "PageServer", []), ("method", "Run", ["PageServer"]), ("function", "main", []), ("route", "/v2/x", ["GET", "/v2/x"]), ("route", "/y", ["ANY", "/y"])]
    assert found.blocks[1].doc == "Serves pages. Fast." and {"entrypoint", "server", "v2", "any"} <= found.tags


def test_yaml():
    text = "# Values\nkind: Deployment\nspec:\n  containers:\n    - image: a\n      on: true\n    - image: b\n  ports: [1, 2]\n---\nkind: Service\n"
    found = P.analyze("chart/values.yaml", text)
    assert kinds(found.blocks) == [("key", "kind", ["Deployment"]), ("key", "spec.containers.image", ["a"]), ("key", "spec.containers.True", ["true"]), ("key", "spec.ports", ["1, 2"]), ("key", "kind", ["Service"])]
    assert {"helm", "k8s", "deployment", "service"} <= found.tags and found.header == "Values"
    assert P.analyze("x.yaml", "a: [") is None


def test_markdown():
    text = "---\nx: 1\n---\n# ADR 7: Use Spark\n\n## Status\n\nAccepted, 2024\n\n```\n## not a heading\n```\n## Setup ##\n### Deep\nlast updated: May\n## Setup\n" + "| a | b |\n" * 5
    found = P.analyze("docs/adr-7.md", text)
    assert kinds(found.blocks) == [("title", "ADR 7: Use Spark", []), ("section", "Status", []), ("status", "Accepted, 2024", []), ("section", "Setup", []), ("subsection", "Deep", []), ("last_updated", "May", []), ("section", "Setup", []), ("table", "5 rows", [])]
    assert {"adr", "adr-7", "docs", "accepted", "spark", "setup"} <= found.tags
    before, parts = P.sections(text)
    assert before.startswith("# ADR 7") and [s.slug for s in parts] == ["status", "setup", "setup-2"] and parts[1].subsections == ["Deep"]


def test_udtf(spark):
    P.register(spark)
    spark.createDataFrame([("a.tf", 'module "m" {}')], "path string, content string").createOrReplaceTempView("src")
    assert [r["name"] for r in spark.sql("select b.name from src, lateral parse_blocks(path, content) b").collect()] == ["m"]


def test_glossary(spark):
    text = "# Glossary\n| Term | Meaning |\n|---|---|\n| Big Box | Large storage container (old) |\n| 12 | no letters |\n\n| x | y |\n"
    f = spark.createDataFrame([(1, "a.md", text), (2, "b.md", "nothing"), (3, "terms.md", "|a|b|\n|-|-|\n| big box | storage vault |")], "pos int, path string, content string")
    assert {r["term"]: r["aliases"] for r in glossary.suggested(f).collect()} == {"big-box": ["large", "storage", "container", "vault"]}
    assert glossary.suggested(f, 5).count() == 0


def test_store_round_trip_and_lenient_reading(spark, tmp_path):
    p = tmp_path / "memories.jsonl"
    p.write_text('{"id": "1", "ts": "t", "text": "a", "kind": "odd", "source_lines": [1, 2]}\n\n[1]\nnot json\n{"id": "2", "ts": "t"}\n{"id": "3", "ts": "t", "text": "b", "deleted_at": "x", "kind": "rule", "more": 1}\n')
    e = jsonl.read_entries(spark, str(p), deleted=True)
    assert [(r["id"], r["kind"], r["pos"], r["source"]) for r in e.orderBy("pos").collect()] == [("1", "fact", 0, "manual"), ("3", "rule", 5, "manual")]
    assert [r["id"] for r in jsonl.read_entries(spark, str(p)).collect()] == ["1"]
    new = jsonl.create_entry(spark, "c", ["X"])
    jsonl.append_entries(new, str(p))
    jsonl.rewrite_entries(jsonl.read_entries(spark, str(p), deleted=True), str(p))
    lines = [json.loads(x) for x in p.read_text().splitlines()]
    assert [x["text"] for x in lines] == ["a", "b", "c"] and "kind" not in lines[0] and lines[2]["tags"] == ["x"] and len(lines[2]["id"]) == 26


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    jsonl.write_version(df, str(tmp_path))
    jsonl.write_version(jsonl.read_version(spark, str(tmp_path)).union(df), str(tmp_path))
    assert jsonl.read_version(spark, str(tmp_path)).count() == 2


def test_session_logs(spark, tmp_path):
    rows = [
        {"type": "user", "cwd": "/r", "timestamp": "1", "message": {"content": []}},
        {"type": "assistant", "timestamp": "2", "message": {"content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "timestamp": "3", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "old"}, {"type": "tool_result", "tool_use_id": "t1", "content": "new"}]}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = jsonl.session_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["event"], r["tool_name"], r["result"], r["run_id"]) for r in got] == [("run_started", None, None, "s1"), ("tool_called", "Bash", "new", "s1")]


def test_question_corpus_takes_the_shortest_array(spark, tmp_path):
    q = {"question_id": "q", "haystack_session_ids": ["a", "b"], "haystack_dates": ["x", "y", "z"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "user"}], [], []]}
    (tmp_path / "q.jsonl").write_text(json.dumps(q))
    got = jsonl.question_corpus(jsonl.questions(spark, str(tmp_path / "q.jsonl"))).orderBy("pos").collect()
    assert [(r["doc"], r["session_id"], r["text"]) for r in got] == [("session/q/s000", "a", "user: hi"), ("session/q/s001", "b", "")]


@pytest.mark.parametrize(("rule", "path", "hit"), [("*.log", "a/b.log", True), ("/x", "x/y", True), ("/x", "a/x", False), ("out/", "out/a", True), ("a/**/z", "a/b/c/z", True), ("a?c", "abc", True), ("[ab].md", "b.md", True), ("x.md", "x.mdx", False)])
def test_ignore_rules(spark, rule, path, hit):
    assert spark.range(1).select(files.ignored(F.lit(path), [rule]).alias("x")).first()["x"] is hit


def test_negated_rules_and_skipped_folders(spark):
    f = lambda p, *r: spark.range(1).select(files.ignored(F.lit(p), r).alias("x")).first()["x"]
    assert f("a.log", "*.log", "!a.log") is False and f("node_modules/x.js") is True and f("a.egg-info/x") is True and f(".hidden/x") is True
    w = lambda p: spark.range(1).select(files.watchable(F.lit(p)).alias("x")).first()["x"]
    assert [w(p) for p in ("a/b.py", ".env", "a/.#x", "x~", "a.swp", "~$doc")] == [True, False, False, False, False, False]


@pytest.fixture
def repo(tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    '''Doc.'''\n")
    (tmp_path / "README.md").write_text("# Top\n" + "".join(f"## S{i}\n{'text ' * 100}\n" for i in range(4)))
    (tmp_path / "Makefile").write_text("all:\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    return tmp_path, git


def test_index_update_and_verify(spark, repo):
    root, git = repo
    tree = files.read_tree(spark, str(root))
    e = files.build_entries(tree, "t0", files.head(str(root), short=True)).cache()
    by = {r["source_ref"]: r for r in e.collect()}
    assert {"src/a.py", "README.md", "README.md#s0", "README.md#s1", "README.md#s2", "README.md#s3", "Makefile", ".", "src", files.SUMMARY_REF} == set(by)
    assert by["src/a.py"]["text"].endswith("\nDocs: Doc.") and "1 × Python" in by["src"]["text"] and len({r["id"] for r in by.values()}) == len(by)
    git("mv", "src/a.py", "src/b.py")
    (root / "README.md").write_text("# Top\n## S0\nshort\n")
    git("add", ".")
    git("commit", "-qm", "two")
    changes = files.changed_files(spark, str(root), "HEAD~1")
    assert {(r["status"], r["path"]) for r in changes.collect()} == {("D", "src/a.py"), ("A", "src/b.py"), ("M", "README.md")}
    assert files.renames(str(root)) == [("src/a.py", "src/b.py")] and store.resolve_renames(["src/a.py"], files.renames(str(root))) == {"src/a.py": "src/b.py"}
    again = files.reindexed(e, files.read_tree(spark, str(root)), changes, "t1")
    now = {r["source_ref"]: r["ts"] for r in again.collect()}
    assert set(now) == {"src/b.py", "README.md", "Makefile", ".", "src", files.SUMMARY_REF}
    assert now["Makefile"] == "t0" and now["README.md"] == "t1"


def test_overrides_and_params(tmp_path):
    (tmp_path / "c.yaml").write_text("mmr: {enabled: true, lambda: 0.5}\nrerank: {top_k: x}\n")
    p = config.search_params(tmp_path / "c.yaml", hybrid_alpha=0.2)
    assert (p.mmr_enabled, p.mmr_lambda, p.hybrid_alpha, p.rerank_top_k) == (True, 0.5, 0.2, 0)
    (tmp_path / "p.yaml").write_text("disabled_parsers: [.MD, 3]\nextension_labels: {'.Graphql': G}\n")
    o = config.parser_overrides(tmp_path / "p.yaml")
    assert o.disabled == {"md"} and o.labels == {"graphql": "G"}
    (tmp_path / "bad.yaml").write_text("a: [")
    assert config.parser_overrides(tmp_path / "bad.yaml").error and config.search_params(tmp_path / "bad.yaml") == config.search_params(tmp_path / "none.yaml")
    assert config.snapshot_name("a b/c") == "a-b-c" and config.snapshot_name(None) == "snapshot"


def test_provenance_needs_equal_content(spark):
    cols = "id string, ts string, source_hash string, verified_at string, drifted_at string"
    old = spark.createDataFrame([("1", "old", "h", "v", None), ("2", "old", "h", "v", None), ("3", "old", None, "v", None)], cols)
    new = spark.createDataFrame([("1", "new", "h", None, None), ("2", "new", "x", None, None), ("3", "new", None, None, None)], cols)
    assert {r["id"]: (r["ts"], r["verified_at"]) for r in store.carry_provenance(new, old).collect()} == {"1": ("old", "v"), "2": ("new", None), "3": ("new", None)}


def test_last_operation_across_batches(spark, tmp_path):
    src, out = tmp_path / "q", []
    src.mkdir()
    (src / "1.json").write_text('{"ts": "1", "path": "a", "op": "created"}\n{"ts": "2", "path": "b", "op": "created"}\n')
    stream = streams.last_op_state(streams.queue(spark, str(src)))
    run = lambda: stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((r["path"], r["op"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    (src / "2.json").write_text('{"ts": "3", "path": "a", "op": "deleted"}\n{"ts": "1", "path": "b", "op": "modified"}\n')
    run()
    assert sorted(out[:2]) == [("a", "created"), ("b", "created")] and sorted(out[2:]) == [("a", "deleted"), ("b", "created")]


def test_apply_changes_is_idempotent(spark):
    state = {"t": spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")}

    def write(df):
        state["t"] = spark.createDataFrame(df.collect(), "path string, v int")

    apply = streams.apply_changes(lambda: state["t"], write, lambda p: p.withColumn("v", F.lit(2)))
    batch = spark.createDataFrame([("1", "a", "modified"), ("2", "b", "deleted"), ("3", "c", "created")], "ts string, path string, op string")
    for _ in range(2):
        apply(batch, 0)
        assert sorted(map(tuple, state["t"].collect())) == [("a", 2), ("c", 2)]
