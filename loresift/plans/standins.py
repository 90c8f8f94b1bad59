"""The driver's tables in the roles of the engine's own: entries, queries, gold sets, conversations and vectors.

Each role exists twice, as a DataFrame and as a DuckDB common table expression of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-09-01T00:00:00+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, deleted: bool = False, labelled: bool = True) -> DataFrame:
    """Memory entries: documents with their labels; soft-deleted ones only if asked for.

    Not ``labelled``: one row for each document and no ``kind``, so that texts aren't shuffled to meet labels nobody reads.
    """
    d = table(spark, sf_dir, "documents")
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left") if labelled else d.withColumn("quality", F.lit(None).cast("int"))
    k = F.col("doc_id")
    flag = lambda n, when: F.when(k % n == 0, F.lit(when))
    d = d.select(
        F.lit(0).alias("corpus"),
        k.alias("doc"),
        k.alias("pos"),
        k.cast("string").alias("id"),
        "text",
        F.array("lang", "source").alias("tags"),
        F.when(F.col("quality") == 1, "rule").when(F.col("quality") == 0, "pattern").otherwise("fact").alias("kind"),
        F.when(k % 5 == 0, "manual").otherwise("index").alias("source"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.floor(k / 4).cast("string"), F.lit(".md"), F.when(k % 4 > 0, F.concat(F.lit("#s"), (k % 4).cast("string"))).otherwise("")).alias("source_ref"),
        F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00+00:00")).alias("ts"),
        F.sha2("text", 256).alias("source_hash"),
        flag(3, "2024-05-01T00:00:00+00:00").alias("verified_at"),
        flag(11, "2024-05-15T00:00:00+00:00").alias("drifted_at"),
        flag(17, "2024-06-01T00:00:00+00:00").alias("deleted_at"),
    )
    d = d if labelled else d.drop("kind")
    return d if deleted else d.where("deleted_at is null")


ENTRIES = """all_entries as (
  select 0 corpus, d.doc_id doc, d.doc_id pos, d.doc_id::varchar id, text, [lang, d.source] tags,
    case quality when 1 then 'rule' when 0 then 'pattern' else 'fact' end kind,
    case when d.doc_id % 5 = 0 then 'manual' else 'index' end source,
    d.source || '/' || lang || '/' || (d.doc_id // 4)::varchar || '.md' || case when d.doc_id % 4 > 0 then '#s' || (d.doc_id % 4)::varchar else '' end source_ref,
    strftime(date '2024-01-01' + (d.doc_id % 365)::int, '%Y-%m-%d') || 'T00:00:00+00:00' ts,
    sha256(text) source_hash,
    case when d.doc_id % 3 = 0 then '2024-05-01T00:00:00+00:00' end verified_at,
    case when d.doc_id % 11 = 0 then '2024-05-15T00:00:00+00:00' end drifted_at,
    case when d.doc_id % 17 = 0 then '2024-06-01T00:00:00+00:00' end deleted_at
  from documents d left join labels l on d.doc_id = l.doc_id),
entries as (select * from all_entries where deleted_at is null)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: their first eight white-space tokens, as people ask in a few words; the rest of a passage isn't read."""
    q = table(spark, sf_dir, "benchmark")
    words = F.slice(F.filter(F.split("text", "\\s+"), lambda t: t != ""), 1, 8)
    return q.select(F.lit(0).alias("corpus"), F.col("item_id").alias("query"), F.array_join(words, " ").alias("text"))


QUERIES = r"""queries as (
  select 0 corpus, item_id query, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')[:8], ' ') as text from benchmark)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query, doc)``: live entries that hold the benchmark passage word for word; the stated passages meet every text."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    return entries(spark, sf_dir).join(passages, F.contains("text", "passage")).select("query", "doc")


GOLD = "gold as (select item_id query, doc from entries e join benchmark b on contains(e.text, b.text))"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of four corpora: role-prefixed turns in order."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    c = c.groupBy("conv_id").agg(turns.alias("ts"))
    return c.select((F.col("conv_id") % 4).cast("int").alias("corpus"), F.col("conv_id").alias("doc"), F.col("conv_id").alias("pos"), F.array_join("ts.t", "\n").alias("text"))


CONVERSATIONS = """convs as (
  select (conv_id % 4)::int corpus, conv_id doc, conv_id pos, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id)"""
