"""Commands over a store folder: ``python -m loresift.cli --store DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import loresift
from loresift.functions import aliases
from loresift.operators import ask, benchmark, bm25, evaluate, pairs, rank, regression, render, store, vectors
from loresift.sources import config, files, glossary, jsonl
from loresift.streaming import watching

#: Rows that lists of findings show; the rest is counted.
SHOWN = 20
#: Turns after which a hook may speak again, the shortest prompt it answers, and how much it gives.
HOOK_TURNS, HOOK_CHARS, HOOK_ENTRIES = 5, 30, 8
HOOK_MARK = "<loresift-context>"


def documents(entries: DataFrame, p: bm25.SearchParams) -> DataFrame:
    return entries.select(F.lit(0).alias("corpus"), F.col("pos").alias("doc"), "pos", bm25.field_text(F.col("text"), F.col("source_ref"), p).alias("text"), "kind", "source", "source_ref")


def ranked(spark: SparkSession, entries: DataFrame, query: str, p: bm25.SearchParams, tag: str | None = None, table: aliases.Table = aliases.BUILT_IN, cache: DataFrame | None = None, embed: Callable | None = None, reranker: Callable | None = None) -> DataFrame:
    """Entries with score and rank for one query: tag filter, fields, aliases, and whatever ``p`` asks of ``bm25.search``."""
    e = rank.with_tag(entries, tag) if tag else entries
    docs = documents(e, p)
    q = spark.createDataFrame([(0, 0, query)], "corpus int, query int, text string").withColumn("text", aliases.expanded(F.col("text"), table))
    near = None
    if p.hybrid_alpha > 0:
        near = vectors.for_search(e.select(F.lit(0).alias("corpus"), F.col("pos").alias("doc"), "text"), q.withColumn("text", F.lit(query)), cache if cache is not None else vectors.empty(spark), embed)
    best = bm25.search(docs, q, p, near, reranker)
    return e.join(best.select(F.col("doc").alias("pos"), "score", "rank"), "pos").orderBy("rank")


def ranked_many(entries: DataFrame, questions: DataFrame, p: bm25.SearchParams, table: aliases.Table) -> DataFrame:
    """``(qid, id, source_ref, kind, score, rank, text, tags)`` for all ``questions(qid, question)`` in one job."""
    q = questions.select(F.lit(0).alias("corpus"), F.col("qid").alias("query"), aliases.expanded(F.col("question"), table).alias("text"))
    best = bm25.search(documents(entries, p), q, p)
    return best.select(F.col("query").alias("qid"), F.col("doc").alias("pos"), "score", "rank").join(entries.select("pos", "id", "source_ref", "kind", "text", "tags"), "pos")


def evaluated(entries: DataFrame, found: DataFrame, p: bm25.SearchParams, table: aliases.Table) -> tuple[DataFrame, DataFrame]:
    """Strict and soft ``(qid, item, first)`` of evaluation pairs ``(qid, query, gold_files)``."""
    best = ranked_many(entries, found.select("qid", F.col("query").alias("question")), p.changed(top_n=max(evaluate.KS)), table)
    got = best.select(F.col("qid").alias("query"), F.substring_index(F.coalesce("source_ref", F.lit("")), "#", 1).alias("item"), "rank", "text")
    gold = found.select(F.col("qid").alias("query"), F.explode("gold_files").alias("item"))
    return evaluate.found(got, gold), evaluate.found(got, gold, evaluate.mentioned(F.col("gold_item"), F.col("text")))


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="loresift")
    a.add_argument("--store", default=".loresift")
    a.add_argument("--version", action="version", version=f"loresift {loresift.__version__}")
    sub = a.add_subparsers(dest="command", required=True)
    for name in ("recall", "context"):
        c = sub.add_parser(name)
        c.add_argument("query", nargs="?", default="")
        c.add_argument("-n", type=int, default=10)
        c.add_argument("--tag")
        c.add_argument("--json", action="store_true")
        c.add_argument("--hybrid-alpha", type=float)
        c.add_argument("--rerank-top-k", type=int)
        c.add_argument("--mmr-lambda", type=float)
        c.add_argument("--mmr", action=argparse.BooleanOptionalAction)
        if name == "context":
            for flag in ("--session", "--new", "--reset-session", "--history"):
                c.add_argument(flag, action="store_true")
    c = sub.add_parser("remember")
    c.add_argument("text")
    c.add_argument("--tag", action="append", default=[])
    c.add_argument("--kind", default="fact")
    c = sub.add_parser("list")
    c.add_argument("--tag")
    c.add_argument("-n", type=int, default=50)
    c = sub.add_parser("forget")
    c.add_argument("id")
    c.add_argument("--revive", action="store_true")
    for name in ("index", "verify", "suggest-aliases"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("--scope", default=".")
        if name == "verify":
            c.add_argument("--follow-renames", action=argparse.BooleanOptionalAction, default=True)
    c = sub.add_parser("update")
    c.add_argument("root")
    c.add_argument("--since", default="HEAD~1")
    c = sub.add_parser("review")
    c.add_argument("root", nargs="?", default=".")
    for name in ("init", "hot", "stats"):
        sub.add_parser(name)
    c = sub.add_parser("testq")
    c.add_argument("--record", nargs="?", const="")
    c.add_argument("--diff", nargs="?", const="")
    c.add_argument("-v", "--verbose", action="store_true")
    for name in ("eval", "sweep"):
        c = sub.add_parser(name)
        c.add_argument("logs")
        c.add_argument("--run", action="append")
        c.add_argument("--days", type=float)
        c.add_argument("--cwd")
        c.add_argument("--tag")
        c.add_argument("--window", type=int, default=pairs.WINDOW)
        c.add_argument("--command-name", default=pairs.COMMAND)
        c.add_argument("--frozen", action="store_true", help="the logs are a file of frozen pairs")
        c.add_argument("--freeze")
        c.add_argument("--out")
    sub.choices["sweep"].add_argument("--set", action="append", default=[], metavar="NAME=V1,V2")
    c = sub.add_parser("eval-conversations")
    c.add_argument("questions")
    c.add_argument("--out")
    for name in ("watch", "flush"):
        c = sub.add_parser(name)
        c.add_argument("--list", required=True)
        c.add_argument("--every", type=float, default=watching.EVERY)
        c.add_argument("--rounds", type=int)
    c = sub.add_parser("hook")
    c.add_argument("what", choices=["inject"])
    return a


def turns_since_mark(path: str | None) -> int:
    """User turns in a session log since the hook last spoke; as many as it waits for, if it never did or there is no log."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines() if path else []
    except OSError:
        lines = []
    n = HOOK_TURNS
    for line in lines:
        if HOOK_MARK in line:
            n = 0
        elif '"type"' in line and json_type(line) == "user":
            n += 1
    return n


def json_type(line: str) -> str | None:
    try:
        row = json.loads(line)
    except ValueError:
        return None
    return row.get("type") if isinstance(row, dict) else None


def main(argv: list[str] | None = None, embed: Callable | None = None, reranker: Callable | None = None) -> int:
    """Runs one command; ``embed`` and ``reranker`` are whatever models the caller plugs in."""
    o = parser().parse_args(argv)
    if o.command == "hook":
        try:
            payload = json.load(sys.stdin)
        except ValueError:
            payload = {}
        o.query = str(payload.get("prompt") or "").strip()
        if len(o.query) < HOOK_CHARS or turns_since_mark(payload.get("transcript_path")) < HOOK_TURNS:
            return 0
        o.n, o.tag, o.json, o.hybrid_alpha, o.rerank_top_k, o.mmr, o.mmr_lambda, o.new, o.reset_session, o.history, o.session = HOOK_ENTRIES, None, False, None, None, None, None, False, False, False, True
    spark = SparkSession.builder.appName("loresift").getOrCreate()
    folder = Path(o.store)
    folder.mkdir(parents=True, exist_ok=True)
    path, now = folder / "entries.jsonl", datetime.now(UTC).isoformat(timespec="seconds")
    path.touch()
    everything = jsonl.read_entries(spark, str(path), deleted=True)
    live = store.live(everything)
    overrides = config.parser_overrides(folder / "parsers.yaml")
    if overrides.error:
        warnings.warn(overrides.error, stacklevel=2)

    def save(df: DataFrame) -> None:
        order = Window.orderBy(F.coalesce("pos", F.lit(1 << 62)), "id")  # one store file
        jsonl.rewrite_entries(df.withColumn("pos", F.row_number().over(order).cast("long")), str(path))

    def show(df: DataFrame, most: int | None = None) -> None:
        rows = df.collect() if most is None else df.limit(most + 1).collect()
        print("\n".join(json.dumps(r.asDict(), ensure_ascii=False, default=str) for r in rows[:most]))
        if most is not None and len(rows) > most:
            print(f"... {df.count() - most} more")

    table = aliases.project_table(folder)
    p = config.search_params(folder / "config.yaml", hybrid_alpha=getattr(o, "hybrid_alpha", None), rerank_top_k=getattr(o, "rerank_top_k", None), mmr_enabled=getattr(o, "mmr", None), mmr_lambda=getattr(o, "mmr_lambda", None))
    if o.command == "init":
        for name, text in (("config.yaml", "mmr:\n  enabled: false\n  lambda: 0.7\nhybrid:\n  alpha: 0.0\nrerank:\n  top_k: 0\n"), ("aliases.yaml", "# term: [alias, ...]\n"), ("parsers.yaml", "disabled_parsers: []\n# key_files: {justfile: Command runner}\n# extension_labels: {kt: Kotlin}\n"), ("testq.yaml", "# - question: where is the store\n#   must_match: [{source_ref_prefix: src/}]\n")):
            if not (folder / name).exists():
                (folder / name).write_text(text, encoding="utf-8")
        print(f"store in {folder}")
    elif o.command in ("recall", "context", "hook"):
        return answer(spark, o, live, folder, p, table, now, embed, reranker)
    elif o.command == "remember":
        new = jsonl.create_entry(spark, o.text, o.tag, kind=o.kind)
        jsonl.append_entries(new, str(path))
        print(new.first()["id"])
    elif o.command == "list":
        show(store.tail(live, o.n, o.tag).select("id", "kind", "source", "text"))
    elif o.command == "forget":
        hit = [r["id"] for r in store.with_prefix(everything, o.id).select("id").limit(2).collect()]
        if len(hit) != 1:
            print("no entry" if not hit else "ambiguous prefix", file=sys.stderr)
            return 1
        gone = F.lit(None).cast("string") if o.revive else F.lit(now)
        save(everything.withColumn("deleted_at", F.when(F.col("id") == hit[0], gone).otherwise(F.col("deleted_at"))))
    elif o.command == "index":
        tree = files.read_tree(spark, o.root, files.ignore_rules(o.root), o.scope)
        new = store.carry_provenance(files.build_entries(tree, now, files.head(o.root), o.scope == ".", overrides), everything)
        save(store.replace_scope(everything, new.withColumn("pos", F.lit(None).cast("long")), o.scope))
    elif o.command == "update":
        tree = files.read_tree(spark, o.root, files.ignore_rules(o.root))
        save(files.reindexed(everything, tree, files.changed_files(spark, o.root, o.since), now, files.head(o.root), overrides))
    elif o.command == "verify":
        tree = files.build_entries(files.read_tree(spark, o.root, files.ignore_rules(o.root)), now, overrides=overrides)
        status = store.verify_following(live, tree.select(F.col("source_ref").alias("path"), F.col("source_hash").alias("hash")), files.renames(o.root) if o.follow_renames else [])
        mark = everything.join(status, "id", "left").persist()
        show(mark.where("status is not null").groupBy("status").count())
        show(mark.where("status in ('drifted', 'missing')").select("id", "status", "source_ref", "new_ref"), SHOWN)
        good, bad = F.col("status").isin("verified", "renamed"), F.col("status").isin("drifted", "missing")
        none = F.lit(None).cast("string")
        done = mark.withColumns({
            "verified_at": F.when(good, F.lit(now)).when(bad, none).otherwise(F.col("verified_at")),
            "drifted_at": F.when(bad, F.lit(now)).when(good, none).otherwise(F.col("drifted_at")),
            "source_ref": F.when(F.col("status") == "renamed", F.col("new_ref")).otherwise(F.col("source_ref")),
        })
        save(done.drop("status", "new_ref"))
    elif o.command == "suggest-aliases":
        tree = files.read_tree(spark, o.root, files.ignore_rules(o.root)).where("ext in ('md', 'mdx')")
        show(glossary.suggested(tree.select(F.xxhash64("path").alias("pos"), "path", "content")).orderBy("term"))
    elif o.command == "hot":
        text, _ = render.hot(everything, now, project=None)
        (folder / "hot.md").write_text(text, encoding="utf-8")
        print(text)
    elif o.command == "review":
        tree = files.build_entries(files.read_tree(spark, o.root, files.ignore_rules(o.root)), now, overrides=overrides)
        show(store.review_flags(everything, tree.select("source_ref"), now), SHOWN)
        show(store.near_duplicates(everything), SHOWN)
    elif o.command == "stats":
        print(render.stats_text(store.stats(everything).first().asDict() | {"store_bytes": files.file_state(path)["size"]}, [r.asDict() for r in store.counts_by(everything, "kind", "source").collect()]))
    elif o.command == "testq":
        return regress(spark, o, live, folder, p, table)
    elif o.command in ("eval", "sweep"):
        if o.frozen:
            found = jsonl.load_pairs(spark, o.logs)
        else:
            logs = jsonl.discovered(o.logs, o.run, o.days)
            if not logs:
                print("no logs", file=sys.stderr)
                return 1
            found = pairs.extract(jsonl.read_events(spark, logs), o.command_name, o.window, o.cwd, tag=o.tag)
        if o.freeze:
            jsonl.freeze_pairs(found, o.freeze)
        numbered = found.withColumn("qid", F.xxhash64("run_id", "query", "turn")).persist()
        if o.command == "eval":
            strict, soft = evaluated(live, numbered, p, table)
            rows = [evaluate.averages(evaluate.judged(x), "k") for x in (strict, soft)]
            mrr = tuple(evaluate.reciprocal_rank(x).agg(F.coalesce(F.avg("rr"), F.lit(0.0))).first()[0] for x in (strict, soft))
            rate = pairs.follow_rate(numbered).first()
            print(render.report(*[[r.asDict() for r in x.collect()] for x in rows], mrr, (rate["rate"], rate["n"])))
        else:
            grid = [{}]
            for item in o.set:
                name, _, values = item.partition("=")
                grid = [{**g, name: type(getattr(p, name))(json.loads(v))} for g in grid for v in values.split(",")]
            rows = None
            for i, g in enumerate(grid):
                one = evaluate.judged(evaluated(live, numbered, p.changed(**g), table)[0], (5,)).agg(F.round(F.avg("hit"), 6).alias("hit_rate"))
                one = one.select(F.lit(i).alias("combo"), F.lit(json.dumps(g)).alias("params"), "hit_rate")
                rows = one if rows is None else rows.union(one)
            rows = [evaluate.best_of(rows, "hit_rate").orderBy("place")]
            show(rows[0], SHOWN)
        if o.out:
            jsonl.write_report(rows[0], o.out, "csv" if o.out.endswith("csv") else "json")
    elif o.command == "eval-conversations":
        judged = benchmark.judge(jsonl.questions(spark, o.questions)).persist()
        show(benchmark.summary(judged))
        show(benchmark.summary(judged, "question_type"))
        if o.out:
            jsonl.write_report(benchmark.wide(judged), o.out)
    else:

        def apply(root: str, changes: DataFrame) -> None:
            had = jsonl.read_entries(spark, str(path), deleted=True)
            tree = files.read_tree(spark, root, files.ignore_rules(root))
            save(files.reindexed(had, tree, changes.select(F.when(F.col("op") == "deleted", "D").otherwise("M").alias("status"), "path"), now, files.head(root), overrides))

        w = watching.Watcher(spark, o.list, folder / "watch", apply)
        if o.command == "flush":
            print(f"applied {w.flush()} paths")
        else:
            w.run(o.every, o.rounds)
            print(json.dumps(watching.heartbeat(folder / "watch")))
    return 0


def answer(spark: SparkSession, o: argparse.Namespace, live: DataFrame, folder: Path, p: bm25.SearchParams, table: aliases.Table, now: str, embed: Callable | None, reranker: Callable | None) -> int:
    """``recall``, ``context`` and the hook: one ranking, rendered; with a session its state goes on."""
    state_path = folder / "session.json"
    state = config.load_state(state_path)
    if getattr(o, "history", False):
        print(ask.history(state))
        return 0
    if getattr(o, "reset_session", False):
        state_path.unlink(missing_ok=True)
        return 0
    if o.command == "context":
        weak = rank.low_signal(spark.createDataFrame([(0, o.query)], "query int, text string")).first()
        if weak:
            print(f"this question says what to do, not with what ({weak['hits']}): names of files, functions or terms would find more", file=sys.stderr)
    in_session = getattr(o, "session", False)
    cache = vectors.load(spark, str(folder / "vectors")) if p.hybrid_alpha > 0 else None
    found = ranked(spark, live, o.query, p.changed(top_n=ask.pool_size(o.n) if in_session else o.n), o.tag, table, cache, embed, reranker)
    if in_session:
        if o.new or ask.is_over(state, now):
            state = ask.new_state(now)
        got = ask.ask(found.withColumns({"query": F.lit(0), "doc": F.col("pos")}), o.query, state, now, o.n)
        config.save_state(state_path, got["state"])
        text = render.as_json(got["top"]) if o.json else ask.page(got)
    else:
        rows = [r.asDict() for r in (render.for_context(found) if o.command == "context" and not o.json else found).orderBy("rank").collect()]
        text = render.as_json(rows) if o.json else render.recall(rows) if o.command == "recall" else render.context(o.query, rows)
    if o.command == "hook":
        text = json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": f"{HOOK_MARK}\n{text.strip()}\n{HOOK_MARK.replace('<', '</')}"}})
    print(text)
    return 0


def regress(spark: SparkSession, o: argparse.Namespace, live: DataFrame, folder: Path, p: bm25.SearchParams, table: aliases.Table) -> int:
    """``testq``: constraints, or a recorded ranking, or the drift against one; 1 if something failed or drifted."""
    fixture = config.fixture(spark, folder / "testq.yaml")
    snapshots = str(folder / "snapshots")
    most = max([8, *(r["top_n"] for r in fixture.select("top_n").distinct().collect())])
    best = ranked_many(live, fixture, p.changed(top_n=most), table).join(fixture.select("qid", "question", "top_n"), "qid").where(F.col("rank") <= F.col("top_n"))
    best = best.select("qid", "question", "rank", "id", "source_ref", "kind", F.round("score", 4).alias("score"))
    if o.record is not None:
        print(f"recorded {config.write_snapshot(best.drop('qid'), snapshots, o.record or datetime.now(UTC).strftime('%Y%m%d-%H%M%S'))}")
        return 0
    if o.diff is not None:
        at = f"{snapshots}/{config.snapshot_name(o.diff)}" if o.diff else config.latest_snapshot(snapshots)
        if not at or not Path(at).exists():
            print("no snapshot", file=sys.stderr)
            return 1
        old = spark.read.parquet(at)
        per = regression.drift(old, best).persist()
        n = regression.drift_counts(per).first()
        for r in per.where("drifted").orderBy("question").limit(SHOWN).collect():
            print(f"{r['question']}: {r['dropped']} dropped, {r['added']} added, {r['reordered']} in another place")
        for r in regression.questions(fixture, old).where("state <> 'kept'").orderBy("question").limit(SHOWN).collect():
            print(f"{r['state']}: {r['question']}")
        print(f"{n['questions'] - n['drifted']}/{n['questions']} unchanged, {n['drifted']} drifted")
        return int(n["drifted"] > 0)
    done = regression.passed(fixture, regression.checked(fixture, best, live)).join(fixture, "qid").orderBy("qid").collect()
    for r in done:
        if not r["passed"] or o.verbose:
            print(f"{'PASS' if r['passed'] else 'FAIL'}  {r['question']}" + "".join(f"\n      missing: {r['must_match'][k]}" for k in r["missing"][:SHOWN]))
    good = sum(r["passed"] for r in done)
    print(f"{good}/{len(done)} passed")
    return int(good < len(done))


if __name__ == "__main__":
    sys.exit(main())
