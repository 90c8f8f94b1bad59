"""Queries on ranked retrieval, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.functions import aliases, refs
from loresift.functions import text as T
from loresift.operators import bm25, rank
from loresift.operators.bm25 import SearchParams
from loresift.plans import standins as S

TAG = "en"


def sql_bm25(docs: str, queries: str, *, boost: bool = False, name: str = "", p: SearchParams = SearchParams()) -> str:
    """CTEs up to ``{name}ranked(corpus, query, doc, pos, score, rank)`` over CTEs ``docs`` and ``queries``."""
    kind = " ".join(f"when '{k}' then {v}::double" for k, v in p.kind_boost.items())
    source = " ".join(f"when '{k}' then {v}::double" for k, v in p.source_boost.items())
    up = f"case when coalesce(score, 0) > 0 then score * (case d.kind {kind} else 1.0::double end) * (case d.source {source} else 1.0::double end) else coalesce(score, 0) end" if boost else "coalesce(score, 0)"
    n = name
    return f"""{n}toks as materialized (select corpus, doc, unnest({T.sql_tokens('text')}) term from {docs}),
{n}len as (select d.corpus, d.doc, count(term) dl from {docs} d left join {n}toks t on d.corpus = t.corpus and d.doc = t.doc group by all),
{n}stats as materialized (select corpus, count(*) n, sum(dl)::double / count(*) avgdl from {n}len group by corpus),
{n}tf as materialized (select corpus, doc, term, count(*) tf from {n}toks group by all),
{n}df as (select f.corpus, term, count(*) df, any_value(n) n from {n}tf f join {n}stats s on f.corpus = s.corpus group by all),
{n}raw as materialized (select corpus, term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) idf0 from {n}df),
{n}idf as materialized (select corpus, term, df, case when idf0 >= 0 then idf0 else {p.eps}::double * avg(idf0) over (partition by corpus) end idf from {n}raw),
{n}qt as (select corpus, query, term, count(*) qtf from (select corpus, query, unnest({T.sql_tokens('text')}) term from {queries}) group by all),
{n}hit as (select f.corpus, q.query, f.doc, sum(q.qtf * i.idf * f.tf * {p.k1 + 1}::double / (f.tf + {p.k1}::double * (1 - {p.b}::double + {p.b}::double * l.dl / s.avgdl))) score
  from {n}qt q join {n}idf i on q.corpus = i.corpus and q.term = i.term join {n}tf f on f.corpus = q.corpus and f.term = q.term
  join {n}len l on l.corpus = f.corpus and l.doc = f.doc join {n}stats s on s.corpus = f.corpus group by all),
{n}scored as materialized (select d.corpus, q.query, d.doc, d.pos, round({up}, {p.digits}) + 0.0::double score
  from {docs} d join {queries} q on d.corpus = q.corpus left join {n}hit h on h.corpus = d.corpus and h.query = q.query and h.doc = d.doc),
{n}ranked as (select *, row_number() over (partition by corpus, query order by score desc, pos) rank from {n}scored)"""


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query", "doc", "score", "rank", *more)


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("corpus", "doc", "pos", "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bm25.search(_plain(spark, d), S.queries(spark, d)))


def bm25_tag_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = rank.with_tag(S.entries(spark, d), TAG).select("corpus", "doc", "pos", "text")
    return _shown(bm25.search(docs, S.queries(spark, d)))


def _conv_queries(spark: SparkSession, d: str) -> DataFrame:
    first = S.table(spark, d, "conversations").where("turn = 0")
    return first.select((F.col("conv_id") % 4).cast("int").alias("corpus"), F.col("conv_id").alias("query"), F.array_join(F.slice(F.filter(F.split("text", "\\s+"), lambda t: t != ""), 1, 8), " ").alias("text"))


def bm25_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Every first turn as a query in its own corpus, with that corpus's statistics."""
    return bm25.search_many(S.conversations(spark, d), _conv_queries(spark, d)).select("corpus", "query", "doc", "score", "rank")


def _fielded(spark: SparkSession, d: str, p: SearchParams = SearchParams()) -> DataFrame:
    e = S.entries(spark, d)
    return e.select("corpus", "doc", "pos", bm25.field_text(F.col("text"), F.col("source_ref"), p).alias("text"), "kind", "source", "source_ref", "tags")


def sql_field_text(p: SearchParams = SearchParams()) -> str:
    base, title, docs = refs.sql_basename("source_ref"), "regexp_extract(text, 'Markdown doc — \"([^\"]+)\"', 1)", "regexp_extract(text, '(?s)\\nDocs: (.+)$', 1)"
    parts = ["text"] + ["case when coalesce(source_ref, '') <> '' then source_ref end"] * p.ref_weight
    parts += [f"case when coalesce(source_ref, '') <> '' and {base} <> '' and lower({base}) <> 'readme' then {base} end"] * p.basename_weight
    parts += [f"nullif({title}, '')"] * p.title_weight + [f"nullif({docs}, '')"] * p.docs_weight
    return f"concat_ws(' ', {', '.join(parts)})"


FIELDED = f"fielded as (select corpus, doc, pos, {sql_field_text()} as text, kind, source, source_ref, tags from entries)"


def bm25_multifield_boosted(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bm25.search(_fielded(spark, d), S.queries(spark, d)))


#: Words put before each query, so that aliases have something to expand.
ALIASED = "postgres api the"


def _aliased(spark: SparkSession, d: str) -> DataFrame:
    return S.queries(spark, d).withColumn("text", aliases.expanded(F.concat(F.lit(ALIASED + " "), "text")))


SQL_ALIASED = f"{S.QUERIES}, aliased as (select corpus, query, {aliases.sql_expanded(repr(ALIASED + ' ') + ' || text')} as text from queries)"


def bm25_alias_expanded(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bm25.search(_plain(spark, d), _aliased(spark, d)))


def alias_expansion(spark: SparkSession, d: str) -> DataFrame:
    return _aliased(spark, d).select("query", F.col("text").alias("expanded"))


def empty_query_store_order(spark: SparkSession, d: str) -> DataFrame:
    """Queries that match nothing: the first entries in store order."""
    return _shown(bm25.search(_plain(spark, d), S.queries(spark, d).withColumn("text", F.lit("zzzzqqq the"))))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _plain(spark, d)
    stats = bm25.term_stats(bm25.document_frequencies(docs), bm25.corpus_stats(docs))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = _plain(spark, d)
    return docs.select("doc", F.size(T.raw_tokens(F.col("text"))).cast("long").alias("dl"))


def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = S.table(spark, d, "documents").select(F.explode(T.raw_tokens(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", T.stem(F.col("token")).alias("stem"), "n")


META = "please review the code and fix issues in "


def _trimmed(q: str = "text"):
    return F.transform(F.filter(F.split(F.col(q), "\\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, f"^[{rank.EDGE_CLASS}]+|[{rank.EDGE_CLASS}]+$", ""))


def low_signal_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark queries after a meta phrase: those with nothing to rank on."""
    q = S.queries(spark, d).withColumn("text", F.concat(F.lit(META), "text"))
    return rank.low_signal(q)


def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = S.table(spark, d, "pages").select(F.explode(F.split("url", "[:?&=]+")).alias("token")).union(S.table(spark, d, "documents").select(F.explode(F.split("text", "\\s+")).alias("token")))
    return w.where("token <> ''").distinct().where(T.identifier_shape(F.col("token"))).select("token")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors, in blocks of queries."""
    v = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("vec").alias("qvec"))
    return rank.nearest(v.select(F.col("vec_id").alias("doc"), F.col("vec_id").alias("pos"), "vec"), q, 10)


def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    v = S.table(spark, d, "embeddings")
    x = v.select(F.col("label").alias("query"), F.col("vec_id").alias("doc"), F.col("embedding")[0].cast("double").alias("score"))
    return x.select("query", "doc", F.round(rank.minmax(F.col("score"), Window.partitionBy("query")), 6).alias("norm"))


def hybrid_fused_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries and documents borrow a vector each, by their number modulo the number of vectors."""
    docs, q = _plain(spark, d), S.queries(spark, d)
    v = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = v.count()
    dv = docs.select("corpus", "doc", (F.col("doc") % n).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    qv = q.select("corpus", "query", (F.col("query") % n).alias("vec_id")).join(v.withColumnRenamed("vec", "qvec"), "vec_id").drop("vec_id")
    return _shown(bm25.search(docs, q, SearchParams(hybrid_alpha=0.3), (dv, qv)))


def _pool(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The best ``n`` of the multi-field search, with references and tags."""
    docs = _fielded(spark, d)
    best = bm25.search(docs, S.queries(spark, d), SearchParams(top_n=n))
    return best.join(docs.select("corpus", "doc", "source_ref", "tags"), ["corpus", "doc"])


def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.mmr(_pool(spark, d, 20), 10, 0.7).select("query", "doc", "score", "rank")


def session_rerank(spark: SparkSession, d: str) -> DataFrame:
    """As if the session had shown the two best results before."""
    pool = _pool(spark, d, 15)
    seen = pool.where("rank <= 2").select("query", "source_ref")
    return rank.session(pool, seen).select("query", "doc", "score", "rank")


#: Documents of one file where sections of files are asked for.
SECTIONS = 64


def sibling_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Up to four other sections of the files shown in the three best, from the twelve results that follow; ``SECTIONS`` documents make a file."""
    ref = F.concat(F.lit("f"), F.floor(F.col("doc") / SECTIONS).cast("string"), F.lit(".md#s"), (F.col("doc") % SECTIONS).cast("string"))
    return rank.siblings(_pool(spark, d, 15).withColumn("source_ref", ref), shown=3).select("query", "doc", "source_ref", "place")


def tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return rank.tag_suggestions(_pool(spark, d, 15), shown=3).select("query", "tag", "n", "place")


def rerank_tail_order(spark: SparkSession, d: str) -> DataFrame:
    """The five best by another scorer (here text length), the tail as it was."""
    pool = _pool(spark, d, 10)
    docs = S.entries(spark, d).select("doc", F.length("text").cast("double").alias("ce"))
    return rank.reranked(pool.join(docs, "doc"), "ce", 5).select("query", "doc", "score", "rank")


_RANKED_FIELDS = f"{S.ENTRIES}, {S.QUERIES}, {FIELDED}, {sql_bm25('fielded', 'queries', boost=True)}, pool15 as (select r.*, e.source_ref, e.tags from ranked r join entries e on r.doc = e.doc where rank <= 15)"
_FILE = refs.sql_file_of("source_ref")
_EDGE = "[" + rank.EDGE_CLASS.replace("'", "''") + "]+"
_DOT = "list_dot_product({a}::double[], {b}::double[])"
_TRIM_WORDS = f"list_transform(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''), lambda t: regexp_replace(regexp_replace(t, '^{_EDGE}', ''), '{_EDGE}$', ''))"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_tag_filtered, bm25_conversations, bm25_multifield_boosted, bm25_alias_expanded, alias_expansion, empty_query_store_order, token_stats, document_lengths, stem_tokens, low_signal_queries, identifier_tokens, cosine_topk, minmax_norm, hybrid_fused_topk, mmr_topk, session_rerank, sibling_suggestions, tag_suggestions, rerank_tail_order)}

_TOP = "select query, doc, score, rank from ranked where rank <= 10"
SQL = {
    "bm25_topk": f"with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries')} {_TOP}",
    "bm25_tag_filtered": f"with {S.ENTRIES}, {S.QUERIES}, tagged as (select * from entries where list_contains(list_transform(tags, lambda t: lower(t)), '{TAG}')), {sql_bm25('tagged', 'queries')} {_TOP}",
    "bm25_conversations": f"""with {S.CONVERSATIONS}, cq as (select (conv_id % 4)::int corpus, conv_id query, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')[:8], ' ') as text from conversations where turn = 0),
{sql_bm25('convs', 'cq')} select corpus, query, doc, score, rank from ranked where rank <= 10""",
    "bm25_multifield_boosted": f"with {S.ENTRIES}, {S.QUERIES}, {FIELDED}, {sql_bm25('fielded', 'queries', boost=True)} {_TOP}",
    "bm25_alias_expanded": f"with {S.ENTRIES}, {SQL_ALIASED}, {sql_bm25('entries', 'aliased')} {_TOP}",
    "alias_expansion": f"with {SQL_ALIASED} select query, text as expanded from aliased",
    "empty_query_store_order": f"with {S.ENTRIES} select item_id query, doc, 0.0::double score, rank from benchmark, (select doc, row_number() over (order by pos) rank from entries) where rank <= 10",
    "token_stats": f"with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries')} select term, df, round(idf, 6) idf from idf",
    "document_lengths": f"with {S.ENTRIES} select doc, len({T.sql_tokens('text')})::bigint dl from entries",
    "stem_tokens": f"select token, {T.sql_stem('token')} stem, n from (select token, count(*) n from (select unnest(list_filter(string_split_regex(lower(text), '{T.SPLIT}'), lambda t: t <> '' and t not in ({T.quoted(T.STOP_WORDS)}))) token from documents) group by token)",
    "low_signal_queries": f"""with {S.QUERIES}, w as (select query, {_TRIM_WORDS.replace('(text,', f"('{META}' || text,")} ws from queries),
h as (select query, ws, list_sort(list_distinct(list_filter(list_transform(ws, lambda t: lower(t)), lambda t: t in ({T.quoted(T.META_WORDS)})))) hits, len(list_filter(ws, lambda t: lower(t) in ({T.quoted(T.META_WORDS)}))) n,
  len(list_filter(ws, lambda t: {T.sql_identifier_shape('t')})) ids from w)
select query, array_to_string(hits[:4], ', ') hits from h where len(ws) >= 3 and ids = 0 and n >= 2""",
    "identifier_tokens": f"select distinct token from (select unnest(string_split_regex(url, '[:?&=]+')) token from pages union all select unnest(string_split_regex(text, '\\s+')) from documents) where token <> '' and {T.sql_identifier_shape('token')}",
    "cosine_topk": f"select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) rank from (select q.vec_id query, v.vec_id doc, round({_DOT.format(a='q.embedding', b='v.embedding')}, 4) score from embeddings q, embeddings v where q.vec_id % 20 = 0)) where rank <= 10",
    "minmax_norm": "select query, doc, round(case when hi <= lo then 0.5 else (x - lo) / (hi - lo) end, 6) norm from (select label query, vec_id doc, embedding[1]::double x, min(embedding[1]::double) over (partition by label) lo, max(embedding[1]::double) over (partition by label) hi from embeddings)",
    "hybrid_fused_topk": f"""with {S.ENTRIES}, {S.QUERIES}, {sql_bm25('entries', 'queries', p=SearchParams(digits=12))},
c as (select s.query, s.doc, s.pos, s.score bm, {_DOT.format(a='qv.embedding', b='dv.embedding')} co from scored s join embeddings qv on qv.vec_id = s.query % (select count(*) from embeddings) join embeddings dv on dv.vec_id = s.doc % (select count(*) from embeddings)),
m as (select *, min(bm) over w b0, max(bm) over w b1, min(co) over w c0, max(co) over w c1 from c window w as (partition by query)),
f as (select query, doc, pos, round(0.7::double * (case when b1 <= b0 then 0.5 else (bm - b0) / (b1 - b0) end) + 0.3::double * (case when c1 <= c0 then 0.5 else (co - c0) / (c1 - c0) end), 4) score from m)
select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, pos) rank from f) where rank <= 10""",
    "mmr_topk": f"""with {_RANKED_FIELDS}, pool20 as (select r.*, e.source_ref from ranked r join entries e on r.doc = e.doc where rank <= 20),
n as (select *, min(score) over (partition by query) lo, max(score) over (partition by query) hi, row_number() over (partition by query, {_FILE} order by rank) nth from pool20),
v as (select *, 0.7::double * (case when hi <= lo then 0.5 else (score - lo) / (hi - lo) end) - 0.3::double * (case when nth > 1 then 1 else 0 end) val from n)
select query, doc, score, r as rank from (select *, row_number() over (partition by query order by round(val, 9) desc, rank) r from v) where r <= 10""",
    "session_rerank": f"""with {_RANKED_FIELDS}, seen as (select query, source_ref from pool15 where rank <= 2),
a as (select p.*, exists (select 1 from seen s where s.query = p.query and s.source_ref = p.source_ref) was, exists (select 1 from seen s where s.query = p.query and {refs.sql_file_of('s.source_ref')} = {refs.sql_file_of('p.source_ref')}) near from pool15 p),
b as (select query, doc, rank, case when score > 0 and was then score * 0.3::double when score > 0 and near then score * 1.5::double else score end s from a)
select query, doc, round(s, 6) score, row_number() over (partition by query order by round(s, 6) desc, rank) rank from b""",
    "sibling_suggestions": f"""with {_RANKED_FIELDS}, p as (select query, doc, rank, 'f' || (doc // {SECTIONS}) f, 'f' || (doc // {SECTIONS}) || '.md#s' || (doc % {SECTIONS}) source_ref from pool15),
c as (select query, doc, source_ref, row_number() over (partition by query order by rank) place from p where rank > 3 and exists (select 1 from p s where s.query = p.query and s.rank <= 3 and s.f = p.f))
select * from c where place <= 4""",
    "tag_suggestions": f"""with {_RANKED_FIELDS}, shown as (select query, unnest(tags) tag from pool15 where rank <= 3),
t as (select query, tag, count(*) n from (select query, unnest(tags) tag from pool15 where rank > 3) where length(tag) between 3 and 30 and tag not in ({T.quoted(rank.NOISE_TAGS)}) group by all),
r as (select t.*, row_number() over (partition by t.query order by n desc, tag) place from t where not exists (select 1 from shown s where s.query = t.query and s.tag = t.tag))
select * from r where place <= 5""",
    "rerank_tail_order": f"""with {_RANKED_FIELDS}, p as (select r.query, r.doc, r.rank old, case when rank <= 5 then length(e.text)::double else score end score from ranked r join entries e on r.doc = e.doc where rank <= 10)
select query, doc, score, row_number() over (partition by query order by case when old <= 5 then 0 else 1 end, case when old <= 5 then -score else 0 end, old) rank from p""",
}
