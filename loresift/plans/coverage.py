"""Queries on regression runs, drift, log parsing, labels and tags, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.functions import aliases, refs
from loresift.operators import benchmark, bm25, pairs, regression, sessions, store
from loresift.plans import standins as S
from loresift.plans.parsing import _lines
from loresift.plans.search import sql_bm25
from loresift.sources import files, parsers

NOW = S.NOW


def regression_run(spark: SparkSession, d: str) -> DataFrame:
    """Two constraints for each benchmark question: the passage's first five words stand in a result, and one result is a fact."""
    q, e = S.queries(spark, d), S.entries(spark, d)
    words = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    must = F.array(F.create_map(F.lit("text_substring"), words), F.create_map(F.lit("kind"), F.lit("fact"), F.lit("source_ref"), F.lit("src0/en/0.md")))
    fixture = S.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit(8).alias("top_n"), must.alias("must_match"))
    best = bm25.search(e.select("corpus", "doc", "pos", "text"), q, bm25.SearchParams(top_n=8)).select(F.col("query").alias("qid"), F.col("doc").cast("string").alias("id"), "rank")
    checks = regression.checked(fixture, best, e)
    done = regression.passed(fixture, checks)
    return checks.join(done.select("qid", "passed"), "qid").select("qid", F.col("place").cast("long").alias("place"), "met", "passed")


def _ranking(spark: SparkSession, d: str, factor: int, keep: str) -> DataFrame:
    """Ten documents for each of twenty questions, in an order that depends on ``factor``."""
    score = ((F.col("doc_id") * factor) % 1009).cast("double") / 10
    rows = S.table(spark, d, "documents").select(F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")).alias("question"), F.col("doc_id").alias("id"), score.alias("score"), (F.col("doc_id") % 20).alias("k"))
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    return rows.where(keep).withColumn("rank", F.row_number().over(w)).where("rank <= 10").drop("k")


def snapshot_questions(spark: SparkSession, d: str) -> DataFrame:
    return regression.questions(_ranking(spark, d, 7919, "k % 2 = 0"), _ranking(spark, d, 7907, "k % 3 = 0"))


def snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    return regression.drift(_ranking(spark, d, 7919, "k < 15"), _ranking(spark, d, 7907, "k > 3"))


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    return regression.drift_counts(snapshot_drift(spark, d))


def follow_rates(spark: SparkSession, d: str) -> DataFrame:
    """Signups without a known output, followed or not, strictly and softly."""
    k = F.col("event_id")
    p = S.table(spark, d, "events").select(F.when(k % 3 > 0, k % 2 == 0).alias("followed"), F.when(k % 3 > 0, k % 5 > 0).alias("followed_soft"))
    one = lambda soft: pairs.follow_rate(p, soft).select(F.lit("soft" if soft else "strict").alias("kind"), F.round("rate", 6).alias("rate"), "n")
    return one(False).union(one(True)).union(pairs.follow_rate(p.where("followed is null")).select(F.lit("unknown").alias("kind"), "rate", "n"))


#: Conversations that are one question's sessions.
SESSIONS = 10


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's first turn as a question over its ten neighbours, itself being the answer."""
    c = S.table(spark, d, "conversations").where("conv_id is not null")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    convs = c.groupBy("conv_id").agg(turns.alias("s")).withColumn("g", F.floor(F.col("conv_id") / SESSIONS))
    group = convs.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("conv_id", "s"))).alias("all"))
    first = c.where("turn = 0").select("conv_id", F.array_join(F.slice(F.filter(F.split("text", "\\s+"), lambda t: t != ""), 1, 8), " ").alias("question"))
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    q = convs.select("conv_id", "g").join(first, "conv_id").join(group, "g").select(
        name(F.col("conv_id")).alias("question_id"), "question", F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("question_type"), F.array(name(F.col("conv_id"))).alias("answer_session_ids"),
        F.transform("all", lambda x: name(x["conv_id"])).alias("haystack_session_ids"), F.transform("all", lambda x: F.lit("2024-01-01")).alias("haystack_dates"), F.transform("all", lambda x: x["s"]).alias("haystack_sessions"),
    )
    return benchmark.summary(benchmark.judge(q), "question_type").select("question_type", "k", "n", "recall_strict", "recall_any", "ndcg", "mrr")


def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Two alias tables of nations, the later one extending the earlier."""
    rows = S.table(spark, d, "nation").orderBy("n_nationkey").collect()
    names = [(r["n_name"].lower(), r["n_nationkey"], r["n_regionkey"]) for r in rows]
    table = aliases.merged({n: [f"r{r}", "x"] for n, _, r in names}, {n: ["y", "x", n] for n, k, _ in names if k % 2 == 0})
    return spark.createDataFrame([(n, ",".join(v)) for n, v in table.items()], "term string, aliases string")


def labels_of_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as they are shown, and references with their lines."""
    t = S.table(spark, d, "documents").select("doc_id", F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("int"), (F.col("doc_id") + 3).cast("int"))).alias("lines"))
    many = t.select("doc_id", "lines", F.explode(F.array(F.lit(1), F.lit(100), F.lit(10_000))).alias("by"), "n_chars")
    return many.select("doc_id", F.col("by").cast("long").alias("by"), refs.size_label(F.col("n_chars") * F.col("by")).alias("size"), refs.ref_label(F.lit("a.md"), F.col("lines")).alias("ref"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    words = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z0-9]+", " "))
    return S.table(spark, d, "documents").select("doc_id", "lang", "source", words.alias("q"))


def parsed_commands(spark: SparkSession, d: str) -> DataFrame:
    """Shell commands as agents type them: the question, the tag and the folder they run in."""
    k = F.col("doc_id")
    to = F.when(k % 3 == 0, F.concat(F.lit("cd /top/x"), (k % 7).cast("string"), F.lit("/../y && "))).when(k % 3 == 1, F.concat(F.lit("cd ../d"), (k % 5).cast("string"), F.lit("/./e && "))).otherwise("")
    mark = F.when(k % 2 == 0, F.lit('"')).otherwise("'")
    command = F.concat(to, F.lit("loresift  context "), mark, "q", mark, F.lit(" --tag "), "lang", F.lit(" -n 3"))
    rows = _asked(spark, d).withColumn("c", command)
    return rows.select("doc_id", pairs.asked(F.col("c")).alias("query"), pairs.asked_tag(F.col("c")).alias("tag"), pairs.working_folder(F.col("c"), F.lit("/home/p")).alias("folder"))


def normalised_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/a/"), (F.col("doc_id") % 3).cast("string"), F.lit("/./b//c/x/y/z/w/../../../../../.claude/worktrees/w"), k, F.lit("/"), "source", F.lit("/"))
    rows = _asked(spark, d).withColumn("path", pairs.normalised(path)).withColumn("root", F.concat(F.lit("/a/"), (F.col("doc_id") % 3).cast("string"), F.lit("/b")))
    return rows.select("doc_id", "path", pairs.relative(F.col("path"), F.col("root")).alias("below"), pairs.relative(F.col("path"), F.lit("/a/1")).alias("elsewhere"))


def printed_refs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see `src/"), "source", F.lit(".py` and `no path` · ref: docs/"), "lang", F.lit(".md#part · ref: .claude/worktrees/w/"), "source", F.lit(".tf)"))
    return _asked(spark, d).select("doc_id", F.array_join(pairs.output_refs(text), ",").alias("refs"))


def markdown_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of conversations written as Markdown: folders, words of the title, section slugs, status."""
    c = S.table(spark, d, "conversations")
    body = _lines(c, "conv_id", ["turn"], F.concat(F.lit("## "), "role", F.lit("\nx")))
    rows = body.select(F.concat(F.lit("logs/ADR-"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Talk of 10"), F.col("conv_id").cast("string"), F.lit("\n\n"), "body").alias("content"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(p, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in parsers.markdown_tags(p, parsers.markdown(c))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["path", "tag"])

    return rows.mapInArrow(run, "path string, tag string")


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and references of the entries built from a tree: files, folders and the summary."""
    s = S.table(spark, d, "supplier")
    body = _lines(s, "s_nationkey", ["s_suppkey"], F.concat(F.lit("class S"), F.col("s_suppkey").cast("string"), F.lit(":\n    pass")))
    directory = F.concat(F.lit("src/n"), (F.col("s_nationkey") % 5).cast("string"))
    tree = body.select(F.concat(directory, F.lit("/m"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit("py").alias("ext"), F.length("body").cast("long").alias("size"), directory.alias("directory"), F.current_timestamp().alias("mtime"), F.sha2("body", 256).alias("hash"), F.col("body").alias("content"))
    return files.build_entries(tree, NOW).select("id", "source_ref", F.array_contains("tags", "directory").alias("is_folder"))


def seen_items(spark: SparkSession, d: str) -> DataFrame:
    """What each user's session had touched before, in the order it first did."""
    e = S.table(spark, d, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return sessions.seen_lists(e, "user_id", ["ts", "event_id"], "k").select("event_id", F.array_join("seen", ",").alias("seen"))


def verify_following(spark: SparkSession, d: str) -> DataFrame:
    """Files of every seventh entry moved twice; half of those were changed on the way."""
    e = S.entries(spark, d).where("doc % 4 = 0")
    old, new = F.col("source_ref"), F.concat(F.lit("moved/"), "source_ref")
    moved = F.col("doc") % 28 == 0
    now = e.where("doc % 12 <> 4").select(F.when(moved, new).otherwise(old).alias("path"), F.when(moved & (F.col("doc") % 56 == 0), F.lit("other")).otherwise(F.col("source_hash")).alias("hash"))
    paths = [r["source_ref"] for r in e.where(moved).select("source_ref").orderBy("doc").collect()]
    return store.verify_following(e, now, [(p, f"between/{p}") for p in paths] + [(f"between/{p}", f"moved/{p}") for p in paths])


QUERIES = {f.__name__: f for f in (regression_run, snapshot_questions, snapshot_drift, snapshot_counts, follow_rates, benchmark_summary, merged_aliases, labels_of_sizes, parsed_commands, normalised_paths, printed_refs, markdown_tags, index_entries, seen_items, verify_following)}


def _sql_ranking(name: str, factor: int, keep: str) -> str:
    return f"""{name} as (select * from (select question, id, score, row_number() over (partition by question order by score desc, id) rank from
  (select 'q' || (doc_id % 20) question, doc_id id, ((doc_id * {factor}) % 1009)::double / 10 score, doc_id % 20 k from documents) where {keep}) where rank <= 10)"""


_DRIFT = f"""{_sql_ranking('o', 7919, 'k < 15')}, {_sql_ranking('n', 7907, 'k > 3')}, b as (select distinct question from o intersect select distinct question from n),
c as (select coalesce(o.question, n.question) question, case when n.rank is null then 'dropped' when o.rank is null then 'added' when o.rank <> n.rank then 'reordered' when abs(o.score - n.score) > 0.01 then 'score_changed' end ch from o full join n on o.question = n.question and o.id = n.id),
dr as (select b.question, count(*) filter (ch = 'dropped') dropped, count(*) filter (ch = 'added') added, count(*) filter (ch = 'reordered') reordered, count(*) filter (ch = 'score_changed') score_changed from b left join c on b.question = c.question group by 1)"""
_WORDS = "trim(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', ' ', 'g'))"
_K = "props->>'$.k'"
SQL = {
    "regression_run": f"""with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries')}, t as (select r.query qid, e.* from ranked r join entries e on e.doc = r.doc where rank <= 8),
w as (select item_id qid, array_to_string(string_split(text, ' ')[:5], ' ') sub from benchmark),
m as (select w.qid, 0::bigint place, coalesce(bool_or(contains(lower(t.text), lower(w.sub))), false) met from w left join t on t.qid = w.qid group by w.qid
  union all select w.qid, 1, coalesce(bool_or(t.kind = 'fact' and t.source_ref = 'src0/en/0.md'), false) from w left join t on t.qid = w.qid group by w.qid)
select qid, place, met, bool_and(met) over (partition by qid) passed from m""",
    "snapshot_questions": f"with {_sql_ranking('a', 7919, 'k % 2 = 0')}, {_sql_ranking('b', 7907, 'k % 3 = 0')} select coalesce(x.question, y.question) question, case when y.question is null then 'new' when x.question is null then 'gone' else 'kept' end state from (select distinct question from a) x full join (select distinct question from b) y on x.question = y.question",
    "snapshot_drift": f"with {_DRIFT} select *, dropped + added + reordered > 0 drifted from dr",
    "snapshot_counts": f"with {_DRIFT} select count(*) questions, count(*) filter (dropped + added + reordered > 0) drifted, sum(dropped)::bigint dropped, sum(added)::bigint added, sum(reordered)::bigint reordered, sum(score_changed)::bigint score_changed from dr",
    "follow_rates": """with p as (select case when event_id % 3 > 0 then event_id % 2 = 0 end f, case when event_id % 3 > 0 then event_id % 5 > 0 end s from events)
select 'strict' kind, round(avg(f::int), 6) rate, count(f) n from p union all select 'soft', round(avg(s::int), 6), count(s) from p union all select 'unknown', null, 0""",
    "benchmark_summary": f"""with q as (select 'c' || conv_id corpus, 'c' || conv_id query, conv_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')[:8], ' ') as text from conversations where turn = 0),
s as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id),
ds as (select q.corpus, s.conv_id doc, row_number() over (partition by q.corpus order by s.conv_id) pos, s.text from q join s on s.conv_id // {SESSIONS} = q.conv_id // {SESSIONS}), {sql_bm25('ds', 'q')},
f as (select q.conv_id, r.rank from q join ranked r on r.query = q.query and r.doc = q.conv_id), j as (select 't' || (conv_id % 3) question_type, k, (rank <= k)::int hit, case when rank <= k then round(1 / log2(rank + 1.0::double), 4) else 0 end ndcg, case when rank <= 20 then 1.0::double / rank else 0 end rr from f, (select unnest([3, 5, 8, 10, 20]) k))
select question_type, k::bigint k, count(*) n, round(avg(hit), 6) recall_strict, round(avg(hit), 6) recall_any, round(avg(ndcg), 6) ndcg, round(avg(rr), 6) mrr from j group by 1, 2""",
    "merged_aliases": "select lower(n_name) term, 'r' || n_regionkey || ',x' || case when n_nationkey % 2 = 0 then ',y' else '' end aliases from nation",
    "labels_of_sizes": """select doc_id, b::bigint as by, case when n < 1024 then n || 'B' when n < 1048576 then (n // 1024) || 'KB' else printf('%.1fMB', n / 1048576.0::double) end size, case when doc_id % 2 = 0 then 'a.md:' || doc_id || '-' || (doc_id + 3) else 'a.md' end ref
from (select doc_id, b, n_chars * b n from documents, (select unnest([1, 100, 10000]) b))""",
    "parsed_commands": f"select doc_id, nullif({_WORDS}, '') query, lang tag, case doc_id % 3 when 0 then '/top/y' when 1 then '/home/d' || (doc_id % 5) || '/e' else '/home/p' end folder from documents",
    "normalised_paths": "select doc_id, '/a/' || (doc_id % 3) || '/b/.claude/worktrees/w' || doc_id || '/' || source path, source below, case when doc_id % 3 = 1 then 'b/' || source end elsewhere from documents",
    "printed_refs": "select doc_id, 'docs/' || lang || '.md,' || source || '.tf,src/' || source || '.py' refs from documents",
    "markdown_tags": """with c as (select distinct conv_id, role from conversations)
select 'logs/ADR-' || conv_id || '.md' path, unnest(list_distinct(['doc', 'logs', 'adr', 'adr-' || conv_id, 'talk'] || case when length('10' || conv_id) > 2 then ['10' || conv_id] else [] end || list(role))) tag from c group by conv_id""",
    "index_entries": f"""with r as (select distinct 'src/n' || (s_nationkey % 5) || '/m' || s_nationkey || '.py' source_ref, false is_folder from supplier union select distinct 'src/n' || (s_nationkey % 5), true from supplier union all select '.#summary', false)
select {refs.sql_stable_id("'index'", 'source_ref')} id, source_ref, is_folder from r""",
    "seen_items": f"""with e as (select event_id, ts, user_id, {_K} k, row_number() over (partition by user_id, {_K} order by ts, event_id) = 1 fresh from events)
select event_id, coalesce(string_agg(case when fresh then k end, ',') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), '') seen from e""",
    "verify_following": f"""with {S.ENTRIES}, e as (select * from entries where doc % 4 = 0)
select id, case when doc % 12 = 4 then 'missing' when doc % 56 = 0 then 'drifted' when doc % 28 = 0 then 'renamed' else 'verified' end status, case when doc % 28 = 0 and doc % 12 <> 4 then 'moved/' || source_ref end new_ref from e""",
}
