"""Queries on events and conversations, and on rendering, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.functions import text as T
from loresift.operators import bm25, sessions
from loresift.operators.bm25 import SearchParams
from loresift.plans import standins as S
from loresift.plans.search import FIELDED, _fielded, sql_bm25


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("seq"), F.get_json_object("props", "$.k").alias("k"))


def gold_window(spark: SparkSession, d: str) -> DataFrame:
    """Signups are queries; clicks and purchases touch the file ``props.k``; five calls are looked ahead."""
    e = _events(spark, d).withColumn("is_query", F.col("event_type") == "signup").withColumn("file", F.when(F.col("event_type").isin("click", "purchase"), F.col("k")))
    return sessions.gold_window(e, 5).select("event_id", F.array_join("gold", ",").alias("gold"))


def first_query_per_session(spark: SparkSession, d: str) -> DataFrame:
    return sessions.first_queries(_events(spark, d).withColumn("query", F.col("k")), 2).select("event_id")


def sessionize_30m(spark: SparkSession, d: str) -> DataFrame:
    e = sessions.sessions(_events(spark, d), "user_id", "ts", "30 minutes", "event_id")
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def turns_since_marker(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are markers, views are turns."""
    return sessions.turns_since(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view")


def seen_so_far(spark: SparkSession, d: str) -> DataFrame:
    return sessions.seen_before(_events(spark, d), "user_id", ["ts", "event_id"], "k").select("event_id", "n_seen", "again")


def tool_results(spark: SparkSession, d: str) -> DataFrame:
    """User turns are calls, assistant turns results of the turn before; the last one counts."""
    c = S.table(spark, d, "conversations")
    calls = c.where("role = 'user'").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"))
    results = c.where("role = 'assistant'").select(F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("tool_use_id"), F.col("turn").alias("seq"), F.length("text").alias("content"))
    return sessions.tool_results(calls, results).select("conv_id", "turn", F.col("result").cast("long").alias("result_chars"))


def conversation_render(spark: SparkSession, d: str) -> DataFrame:
    return S.conversations(spark, d).select("corpus", "doc", "text")


def context_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each query as rendered lines: rules, facts, patterns, each in order of rank."""
    docs = _fielded(spark, d)
    best = bm25.search(docs, S.queries(spark, d), SearchParams())
    e = S.entries(spark, d).select("doc", "kind", "source", "source_ref", F.substring("ts", 1, 10).alias("date"), F.substring("text", 1, 60).alias("head"), "drifted_at")
    order = F.when(F.col("kind") == "rule", 0).when(F.col("kind") == "fact", 1).otherwise(2)
    w = Window.partitionBy("query").orderBy(order, "rank")
    meta = F.concat(F.lit("  ("), F.concat_ws(" · ", "source", "date", F.concat(F.lit("ref: "), "source_ref"), F.when(F.col("drifted_at").isNotNull(), F.lit("DRIFTED"))), F.lit(")"))
    return best.join(e, "doc").withColumn("place", F.row_number().over(w)).select("query", "place", "kind", F.concat(F.lit("- "), "head").alias("line"), meta.alias("meta"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.split("text", "\\n"), 1)
    return S.table(spark, d, "documents").select("doc_id", T.slug(head).alias("slug"))


def truncate_condense(spark: SparkSession, d: str) -> DataFrame:
    section = F.concat(F.lit('Section "S" of `a/b.md`. Subsections: x; y.\n\n## S\n\n'), "text")
    return S.table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 400).alias("cut"), T.condensed(section).alias("line"))


QUERIES = {f.__name__: f for f in (gold_window, first_query_per_session, sessionize_30m, turns_since_marker, seen_so_far, tool_results, conversation_render, context_grouped, slugify, truncate_condense)}

_E = "e as (select event_id, ts, user_id, event_type, props->>'$.k' k from events)"
_PREFIX = "'Section \"S\" of `a/b.md`. Subsections: x; y.' || chr(10) || chr(10) || '## S' || chr(10) || chr(10) || text"
SQL = {
    "gold_window": f"""with {_E}, w as (select event_id, event_type, list_sort(list_distinct(list_filter(list(case when event_type in ('click', 'purchase') then k end) over (partition by user_id order by ts, event_id rows between 1 following and 5 following), lambda x: x is not null))) g from e)
select event_id, array_to_string(g, ',') gold from w where event_type = 'signup' and len(g) > 0""",
    "first_query_per_session": f"with {_E}, r as (select *, row_number() over (partition by user_id, k order by ts, event_id) n from e) select event_id from r where n = 1 and length(k) >= 2",
    "sessionize_30m": f"""with {_E}, g as (select *, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 1 else 0 end gap from e),
s as (select *, sum(gap) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint session from g) select user_id, session, count(*) n, min(event_id) first_event from s group by all""",
    "turns_since_marker": f"""with {_E}, m as (select user_id, max(row(ts, event_id)) filter (event_type = 'purchase') l from e group by 1)
select e.user_id, case when any_value(l) is null then 5 else count(*) filter (event_type = 'view' and row(ts, event_id) > l) end turns from e join m on m.user_id = e.user_id group by 1""",
    "seen_so_far": f"""with {_E}, f as (select *, row_number() over (partition by user_id, k order by ts, event_id) = 1 fst from e)
select event_id, coalesce(sum(fst::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint n_seen, not fst again from f""",
    "tool_results": "select c.conv_id, c.turn, length(r.text)::bigint result_chars from conversations c left join conversations r on r.conv_id = c.conv_id and r.role = 'assistant' and r.turn = c.turn + 1 where c.role = 'user'",
    "conversation_render": f"with {S.CONVERSATIONS} select corpus, doc, text from convs",
    "context_grouped": f"""with {S.ENTRIES}, {S.QUERIES}, {FIELDED}, {sql_bm25('fielded', 'queries', boost=True)}
select r.query, row_number() over (partition by r.query order by case e.kind when 'rule' then 0 when 'fact' then 1 else 2 end, r.rank) place, e.kind, '- ' || e.text[:60] line,
'  (' || concat_ws(' · ', e.source, e.ts[:10], 'ref: ' || e.source_ref, case when e.drifted_at is not null then 'DRIFTED' end) || ')' meta from ranked r join entries e on e.doc = r.doc where r.rank <= 10""",
    "slugify": f"select doc_id, {T.sql_slug('string_split(text, chr(10))[1]')} slug from documents",
    "truncate_condense": f"select doc_id, case when length(text) > 400 then regexp_replace(text[:400], '\\s+$', '') || chr(10) || chr(10) || '[...truncated...]' else text end cut, {T.sql_condensed('(' + _PREFIX + ')')} line from documents",
}
