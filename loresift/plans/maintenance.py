"""Queries on the entry store, each with its DuckDB counterpart.

The old store is the entries with ids not divisible by 7; the new one has ids not divisible by 5, and texts of every ninth differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions import refs
from loresift.functions import text as T
from loresift.operators import bm25, store
from loresift.operators.bm25 import SearchParams
from loresift.plans import standins as S
from loresift.plans.search import sql_bm25


def _all(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d, deleted=True)


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _all(spark, d).select("id", "doc", "ts", "source", "source_ref", "source_hash", "verified_at", "drifted_at")
    changed = F.when(F.col("doc") % 9 == 0, F.sha2(F.concat("source_hash", F.lit("new")), 256)).otherwise(F.col("source_hash"))
    none = F.lit(None).cast("string")
    new = e.where("doc % 5 <> 0").withColumns({"source_hash": changed, "ts": F.lit(S.NOW), "verified_at": none, "drifted_at": none})
    return e.where("doc % 7 <> 0"), new


_OLD_NEW = f"""{S.ENTRIES}, o as (select id, doc, ts, source, source_ref, source_hash, verified_at, drifted_at from all_entries where doc % 7 <> 0),
nw as (select id, doc, '{S.NOW}' ts, source, source_ref, case when doc % 9 = 0 then sha256(source_hash || 'new') else source_hash end source_hash, null::varchar verified_at, null::varchar drifted_at from all_entries where doc % 5 <> 0)"""


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return store.upsert(old, new)


def scoped_replace(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return store.replace_scope(old, new.where(store.in_scope(F.col("source_ref"), "src1")), "src1").select("id", "ts", "source_ref", "source_hash")


def provenance_carry(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return store.carry_provenance(new, old)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files on disk: those of ids divisible by 13 are gone, those divisible by 8 changed."""
    e = _all(spark, d).where("doc % 13 <> 0")
    return e.select(F.col("source_ref").alias("path"), F.when(F.col("doc") % 8 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("source_hash")).alias("hash"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth entry has no hash."""
    return _all(spark, d).withColumn("source_hash", F.when(F.col("doc") % 10 != 0, F.col("source_hash")))


# Two sections can share a reference only across files of one name, so the stand-in joins on the reference alone;
# documents of one source, language and quarter number have distinct anchors.
_VERIFY = f"""{S.ENTRIES}, files as (select source_ref path, case when doc % 8 = 0 then sha256(text || '!') else source_hash end hash from all_entries where doc % 13 <> 0),
v as (select e.id, case when e.doc % 10 = 0 then 'skipped' when f.path is null then 'missing' when f.hash = e.source_hash then 'verified' else 'drifted' end status from entries e left join files f on f.path = e.source_ref)"""


def verify_status(spark: SparkSession, d: str) -> DataFrame:
    return store.verify(_checked(spark, d), _files(spark, d))


def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.verify(_checked(spark, d), _files(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def review_flags(spark: SparkSession, d: str) -> DataFrame:
    return store.review_flags(_all(spark, d), _files(spark, d).select(F.col("path").alias("source_ref")), S.NOW)


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts don't meet their labels; an entry that has several labels is listed as often as a copy, as the SQL's join has it."""
    found = store.near_duplicates(S.entries(spark, d, deleted=True, labelled=False)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
    many = S.table(spark, d, "labels").groupBy(F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    times = F.when(F.col("jaccard") == 1, F.coalesce("n", F.lit(1))).otherwise(F.lit(1))
    return found.join(many, "b", "left").select("a", "b", "jaccard", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(_all(spark, d))


def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.counts_by(_all(spark, d), "kind", "source")


def hot_ranking(spark: SparkSession, d: str) -> DataFrame:
    return store.hot_ranking(_all(spark, d)).select("id", "kind", "rank")


ROOM, HEADER, MOST = 12_000, 13, 8


def hot_budget(spark: SparkSession, d: str) -> DataFrame:
    return store.hot_budget(store.hot_ranking(_all(spark, d)).where("kind <> 'rule'"), ROOM, HEADER, MOST).select("kind", "id", "rank", F.col("used").cast("long").alias("used"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select(F.substring_index("source_ref", "/", 2).alias("directory"), F.col("source_ref").alias("path"), F.col("kind").alias("label"), F.octet_length("text").cast("long").alias("size"))


def directory_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.directory_summary(_listing(spark, d)).drop("size_label", "hash")


def dir_hash(spark: SparkSession, d: str) -> DataFrame:
    return store.directory_summary(_listing(spark, d)).select("directory", "hash")


def repo_summary(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("directory").alias("n_dirs"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rankings with b = 0.85 and with b = 0.5."""
    docs, q = S.entries(spark, d).select("corpus", "doc", "pos", "text"), S.queries(spark, d)
    sides = [bm25.search(docs, q, SearchParams(b=b)).select("query", F.col("doc").alias("id"), "rank", "score") for b in (0.85, 0.5)]
    return store.snapshot_diff(*sides)


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = S.table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("mtime"))
    return e.where("path % 6 <> 0"), e.where("path % 5 <> 0").withColumn("mtime", F.col("mtime") + (F.col("path") % 4 == 0).cast("int"))


def mtime_diff(spark: SparkSession, d: str) -> DataFrame:
    return store.mtime_diff(*_states(spark, d))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return S.table(spark, d, "events").select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("path"), op.alias("op"))


def last_op_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.last_op(_queue(spark, d)).select("path", "op", F.col("first_seq.event_id").alias("first_event"))


def id_prefix(spark: SparkSession, d: str) -> DataFrame:
    return store.with_prefix(_all(spark, d), "17").select("id", "deleted_at")


def list_tail(spark: SparkSession, d: str) -> DataFrame:
    return store.tail(S.entries(spark, d), 50, "EN").select("id", "pos")


CONSTRAINTS = ({"kind": "rule", "tag": "en"}, {"source_ref_prefix": "src1/", "text_substring": "THE "}, {"id": "5"}, {"tag": "EN"})


def constraint_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many live entries hold each of a fixture's constraints."""
    rows = [(i, c) for i, c in enumerate(CONSTRAINTS)]
    c = spark.createDataFrame(rows, "item long, wanted map<string,string>")
    e = S.entries(spark, d)
    hit = store.constraint_holds({k: F.col(k) for k in ("text", "source_ref", "tags", "kind", "id")}, F.col("wanted"))
    return e.crossJoin(F.broadcast(c)).groupBy("item").agg(F.count_if(hit).alias("n"))  # a handful of constraints


def embedding_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct()
    return store.missing_vectors(docs.select("text"), cache)


def cache_compaction(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    cache = docs.select(F.sha2("text", 256).alias("content_hash")).distinct()
    active = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("content_hash"))
    return store.compacted(cache, active).agg(F.count(F.lit(1)).alias("kept"))


def stable_ulid(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("doc", refs.stable_id(F.col("source"), F.col("source_ref")).alias("ulid"))


def reference_parts(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("source_ref")
    return _all(spark, d).select("doc", refs.file_of(r).alias("file"), refs.basename(r).alias("base"), refs.extension(refs.file_of(r)).alias("ext"))


QUERIES = {f.__name__: f for f in (upsert_merge, scoped_replace, provenance_carry, verify_status, verify_counts, review_flags, near_duplicates, store_stats, store_counts, hot_ranking, hot_budget, directory_summary, dir_hash, repo_summary, snapshot_diff, mtime_diff, last_op_wins, id_prefix, list_tail, constraint_matches, embedding_misses, cache_compaction, stable_ulid, reference_parts)}

_COLS = "id, doc, ts, source, source_ref, source_hash, verified_at, drifted_at"
_SCOPE = f"({refs.sql_file_of('source_ref')} = 'src1' or starts_with({refs.sql_file_of('source_ref')}, 'src1/'))"
_HOT = f"{S.ENTRIES}, hot as (select *, row_number() over (partition by kind order by (drifted_at is not null)::int, coalesce(verified_at, '') desc, ts desc, pos) rank from entries where kind <> 'fact' or source <> 'index')"
_LIST = f"{S.ENTRIES}, ls as (select split_part(source_ref, '/', 1) || '/' || split_part(source_ref, '/', 2) directory, source_ref path, kind as lbl, strlen(text) size from all_entries)"
_OP = "case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'modified' end"
_WS = T.sql_word_set("text")

SQL = {
    "upsert_merge": f"with {_OLD_NEW} select {_COLS} from o where id not in (select id from nw) union all select {_COLS} from nw",
    "scoped_replace": f"with {_OLD_NEW} select id, ts, source_ref, source_hash from o where not (source = 'index' and {_SCOPE}) union all select id, ts, source_ref, source_hash from nw where {_SCOPE}",
    "provenance_carry": f"""with {_OLD_NEW} select nw.id, nw.doc, case when s then o.ts else nw.ts end ts, nw.source, nw.source_ref, nw.source_hash, case when s then o.verified_at else nw.verified_at end verified_at, case when s then o.drifted_at else nw.drifted_at end drifted_at
from (select nw.*, coalesce(o.source_hash = nw.source_hash, false) s from nw left join o on o.id = nw.id) nw left join o on o.id = nw.id""",
    "verify_status": f"with {_VERIFY} select * from v",
    "verify_counts": f"with {_VERIFY} select status, count(*) n from v group by status",
    "review_flags": f"""with {S.ENTRIES}, f as (select id, drifted_at is not null drifted, source = 'index' and source_ref not in (select source_ref from all_entries where doc % 13 <> 0) missing_source,
verified_at is null and source = 'manual' and ts::timestamptz < '{S.NOW}'::timestamptz - interval 30 day stale from entries) select * from f where drifted or missing_source or stale""",
    "near_duplicates": f"""with {S.ENTRIES}, w as (select pos, list_sort({_WS}) ws from entries where source = 'manual'), c as (select ws, min(pos) a from w where len(ws) > 0 group by ws),
k as (select a, unnest(ws) x from c), p as (select l.a a, r.a b, count(*) n from k l join k r on l.x = r.x and l.a < r.a group by all)
select a, pos b, 1.0::double jaccard from w join c on w.ws = c.ws where pos <> a
union all select p.a, p.b, round(n / (len(l.ws) + len(r.ws) - n)::double, 6) from p join c l on l.a = p.a join c r on r.a = p.b where n / (len(l.ws) + len(r.ws) - n)::double >= 0.8""",
    "store_stats": f"""with {S.ENTRIES} select count(*) total, count(*) filter (deleted_at is null) live, count(*) filter (deleted_at is not null) deleted, count(*) filter (deleted_at is null and drifted_at is not null) drifted,
count(*) filter (deleted_at is null and verified_at is not null) verified, max(ts) filter (deleted_at is null and source = 'index') latest_index_ts, max(ts) filter (deleted_at is null and source = 'manual') latest_manual_ts from all_entries""",
    "store_counts": f"with {S.ENTRIES} select 'kind' axis, kind as name, count(*) n from entries group by kind union all select 'source', source, count(*) from entries group by source",
    "hot_ranking": f"with {_HOT} select id, kind, rank from hot",
    "hot_budget": f"with {_HOT}, u as (select kind, id, rank, (sum(length(text) + 3) over (partition by kind order by rank) + {HEADER})::bigint used from hot where kind <> 'rule' and rank <= {MOST}) select * from u where used <= {ROOM}",
    "directory_summary": f"""with {_LIST}, b as (select directory, lbl, count(*) n from ls group by all), g as (select directory, string_agg(n || ' × ' || lbl, ', ' order by lbl) labels from b group by 1)
select directory, count(*) n_files, any_value(g.labels) labels, sum(size)::bigint total from ls join g using (directory) group by directory""",
    "dir_hash": f"with {_LIST} select directory, sha256(string_agg(path || '|' || size || chr(10), '' order by path, size::varchar)) hash from ls group by directory",
    "repo_summary": f"with {_LIST} select count(*) n_files, count(distinct directory) n_dirs from ls",
    "snapshot_diff": f"""with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries', name='x_')}, {sql_bm25('entries', 'queries', name='y_', p=SearchParams(b=0.5))},
a as (select query, doc, rank, score from x_ranked where rank <= 10), b as (select query, doc, rank, score from y_ranked where rank <= 10),
j as (select coalesce(a.query, b.query) query, coalesce(a.doc, b.doc) id, case when b.rank is null then 'dropped' when a.rank is null then 'added' when a.rank <> b.rank then 'reordered' when abs(a.score - b.score) > 0.01 then 'score_changed' end change from a full join b on a.query = b.query and a.doc = b.doc)
select * from j where change is not null""",
    "mtime_diff": """with e as (select user_id path, max(event_id) mtime from events group by 1), o as (select * from e where path % 6 <> 0), n as (select path, mtime + (path % 4 = 0)::int mtime from e where path % 5 <> 0),
j as (select coalesce(o.path, n.path) path, case when o.path is null then 'created' when n.path is null then 'deleted' when o.mtime <> n.mtime then 'modified' end op from o full join n on o.path = n.path) select * from j where op is not null""",
    "last_op_wins": f"select user_id path, arg_max({_OP}, row(ts, event_id)) op, arg_min(event_id, row(ts, event_id)) first_event from events group by 1",
    "id_prefix": f"with {S.ENTRIES} select id, deleted_at from all_entries where starts_with(id, '17')",
    "list_tail": f"with {S.ENTRIES} select id, pos from (select * from entries where list_contains(tags, 'en') order by pos desc limit 50)",
    "constraint_matches": f"""with {S.ENTRIES} select 0::bigint item, count(*) filter (kind = 'rule' and list_contains(tags, 'en')) n from entries union all select 1, count(*) filter (starts_with(source_ref, 'src1/') and contains(lower(text), 'the ')) from entries
union all select 2, count(*) filter (id = '5') from entries union all select 3, count(*) filter (list_contains(tags, 'EN')) from entries""",
    "embedding_misses": "select distinct sha256(text) content_hash from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)",
    "cache_compaction": "select count(distinct text) kept from documents where text in (select text from documents where lang = 'en')",
    "stable_ulid": f"with {S.ENTRIES} select doc, {refs.sql_stable_id('source', 'source_ref')} ulid from all_entries",
    "reference_parts": f"with {S.ENTRIES} select doc, {refs.sql_file_of('source_ref')} file, {refs.sql_basename('source_ref')} base, 'md' ext from all_entries",
}
