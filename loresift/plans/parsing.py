"""Queries on parsers and streams: sources are written out from the driver's tables, so SQL knows what must be found."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.plans import standins as S
from loresift.sources import glossary, parsers
from loresift.streaming import streams


def _lines(df: DataFrame, key: str, order: list[str], line) -> DataFrame:
    """``(key, body)``: the lines of every key in order."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("ls"))
    return g.select(key, F.array_join("ls.line", "\n").alias("body"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations")
    body = _lines(c, "conv_id", ["turn"], F.concat(F.lit("## "), "role", F.lit("\n"), "text"))
    return body.select("conv_id", F.concat(F.lit("---\nkind: log\n---\n# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), "body").alias("content"))


def md_sections(spark: SparkSession, d: str) -> DataFrame:
    """H2 sections of conversations written as Markdown."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(c, i, s.title, s.slug, len(s.content)) for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, s in enumerate(parsers.sections(text)[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["conv_id", "pos", "title", "slug", "n_chars"])

    return _markdown(spark, d).mapInArrow(run, "conv_id long, pos long, title string, slug string, n_chars long")


def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d).select(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "content")
    return parsers.blocks_of(files).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def _blocks(spark: SparkSession, key: str, ext: str, body: DataFrame) -> DataFrame:
    files = body.select(F.concat(F.col(key).cast("string"), F.lit(ext)).alias("path"), F.col("body").alias("content"))
    return parsers.blocks_of(files).select("path", F.col("pos").cast("long").alias("pos"), "kind", "name", F.array_join("labels", ",").alias("labels"), "doc")


def tf_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    quoted = lambda kind: F.concat(F.lit(kind + ' "'), "k", F.lit('" {'))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit('resource "aws_s3_bucket" "b'), "k", F.lit('" {'))).when(F.col("event_type") == "view", quoted("variable")).when(F.col("event_type") == "error", quoted("  module")).when(F.col("event_type") == "purchase", F.lit("locals {")).otherwise(F.concat(F.lit("# note "), "k"))
    return _blocks(spark, "user_id", ".tf", _lines(e, "user_id", ["event_id"], line))


def yaml_keys(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    body = _lines(n, "n_regionkey", ["n_nationkey"], F.concat(F.lit("  n"), F.col("n_nationkey").cast("string"), F.lit(": '"), "n_name", F.lit("'")))
    return _blocks(spark, "n_regionkey", ".yaml", body.withColumn("body", F.concat(F.lit("# nations\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\nnations:\n"), "body")))


def py_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("class S"), k, F.lit("(Base, metaclass=Meta):\n    \"\"\"Supplier "), k, F.lit(".\"\"\"\n"))).otherwise(F.concat(F.lit("@app.get('/s/"), k, F.lit("')\nasync def s"), k, F.lit("(x):\n    return x\n")))
    return _blocks(spark, "s_nationkey", ".py", _lines(s, "s_nationkey", ["s_suppkey"], line))


def go_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\n// S"), k, F.lit(" sells.\n// A lot.\ntype S"), k, F.lit(" struct {\n}"))).otherwise(F.concat(F.lit("func (s *Store) Get"), k, F.lit("(id int) {\n}")))
    return _blocks(spark, "s_nationkey", ".go", _lines(s, "s_nationkey", ["s_suppkey"], line))


def glossary_aliases(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    body = _lines(n, "n_regionkey", ["n_nationkey"], F.concat(F.lit("| "), "n_name", F.lit(" | a country located within region"), F.col("n_regionkey").cast("string"), F.lit(" (more) |")))
    files = body.select(F.col("n_regionkey").alias("pos"), F.lit("docs/terms.md").alias("path"), F.concat(F.lit("| Term | Meaning |\n| --- | --- |\n"), "body").alias("content"))
    return glossary.suggested(files).select("term", F.array_join("aliases", ",").alias("aliases"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = S.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _folder(spark: SparkSession) -> str:
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Last operation by user over a stream of events, kept as a table that every batch replaces."""
    out = _folder(spark)
    op = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    changes = _stream(spark, d).select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("path"), op.alias("op"))
    streams.watch(changes, streams.keep_last(out), f"{out}/state").awaitTermination()
    return streams.kept_last(spark, out).select("path", "op")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows over a stream of events."""
    out = _folder(spark)
    e = _stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    query = streams.session_windows(e, "user_id", "ts").writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/v")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/v").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


QUERIES = {f.__name__: f for f in (md_sections, md_blocks, tf_blocks, yaml_keys, py_blocks, go_blocks, glossary_aliases, stream_compaction, stream_sessions)}

_K = "props->>'$.k'"
_POS = "row_number() over (partition by path order by o) - 1 pos"
SQL = {
    "md_sections": "select conv_id, row_number() over (partition by conv_id order by turn) - 1 pos, role title, role || case when k > 1 then '-' || k else '' end slug, length(rtrim('## ' || role || chr(10) || text, ' ' || chr(10) || chr(9))) + 1 n_chars from (select *, row_number() over (partition by conv_id, role order by turn) k from conversations)",
    "md_blocks": "select 'c/' || conv_id || '.md' path, 'title' kind, 1::bigint n from conversations group by conv_id union all select 'c/' || conv_id || '.md', 'section', least(count(*), 30) from conversations group by conv_id",
    "tf_blocks": f"""select path, {_POS}, kind, name, labels, '' doc from (select user_id || '.tf' path, event_id o, case event_type when 'click' then 'resource' when 'view' then 'variable' when 'error' then 'module' else 'locals' end kind,
case event_type when 'click' then 'b' || ({_K}) when 'purchase' then '(block)' else {_K} end as name, case event_type when 'click' then 'aws_s3_bucket' else '' end labels from events where event_type <> 'signup')""",
    "yaml_keys": f"select path, {_POS}, 'key' kind, name, labels, '' doc from (select r_regionkey || '.yaml' path, -1 o, 'region' as name, r_regionkey::varchar labels from region where r_regionkey in (select n_regionkey from nation) union all select n_regionkey || '.yaml', n_nationkey, 'nations.n' || n_nationkey, n_name from nation)",
    "py_blocks": f"""select path, {_POS}, case when e then 'class' else 'route' end kind, case when e then 'S' else 's' end || o as name, case when e then 'Base,Meta' else 'GET,/s/' || o end labels, case when e then 'Supplier ' || o || '.' else '' end doc
from (select s_nationkey || '.py' path, s_suppkey o, s_suppkey % 2 = 0 e from supplier)""",
    "go_blocks": f"""select path, {_POS}, case when e then 'struct' else 'method' end kind, case when e then 'S' else 'Get' end || o as name, case when e then '' else 'Store' end labels, case when e then 'S' || o || ' sells. A lot.' else '' end doc
from (select s_nationkey || '.go' path, s_suppkey o, s_suppkey % 2 = 0 e from supplier)""",
    "glossary_aliases": "select lower(replace(n_name, '_', '')) term, 'country,located,within,region' || n_regionkey aliases from nation",
    "stream_compaction": "select user_id path, arg_max(case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'modified' end, row(ts, event_id)) op from events group by 1",
    "stream_sessions": """with g as (select user_id, ts, case when ts > lag(ts) over w + interval 30 minute then 1 else 0 end gap from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(gap) over (partition by user_id order by ts rows unbounded preceding) s from g) select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) last_us, count(*) n from s group by user_id, s""",
}
