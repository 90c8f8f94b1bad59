"""From raw documents to coded token ids: five stages, each of which works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
Rows with a null id pass the stages that compare by id; null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loresift.llm import decontaminate, mixing, near_dedup, token_output, toxicity
from loresift.llm.common import cut, table
from loresift.llm.queries import crc_fold

#: Targets of the mixing stage are token shares to this power.
MIX_POWER = 0.9


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject; it learns from three quarters of the labels."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2)
    return toxicity.accepted(docs, toxicity.fit(toxicity.labelled_sample(docs, labels)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.representatives(docs, shingle=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that has the target shares of sources, languages and topics."""
    return mixing.sample(docs, power=MIX_POWER)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the coded blocks."""
    return token_output.round_trip(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: SQL can't express the first and the last stage; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut off from the one before by a written table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
