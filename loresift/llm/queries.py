"""The queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.llm import chat, decontaminate, line_dedup, lm, mixing, spotsigs, token_output, toxicity, warc
from loresift.llm.common import table
from loresift.llm.near_dedup import near_duplicates


def crc_fold(column: str, folds: int):
    """crc32 of the column as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.coalesce(crc_fold("doc_id", 5) == 1, F.lit(False))  # a null id is never held out
    scored = lm.score(table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.where(crc_fold("doc_id", 4) != 2)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, num=80, den=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module's helpers

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_token_output": op3_token_output,
        "op4_chat_collapse": op4_chat_collapse,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_warc": op7_warc,
        "op8_mixing": op8_mixing,
        "op9_spotsigs": op9_spotsigs,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "pipeline": pipeline,
    }
