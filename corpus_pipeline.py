"""Five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage reads whole texts, however long, takes an empty table for an empty result, and ignores columns that it does not
name, whatever their names; all but the last return the columns of their input. What nulls, blank texts, ties and
repeated rows come to is said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import decontaminate, mixing, neardup, secrets, toxicity
from scoreloom.llm.storage import materialise


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold stay. Null and blank texts are scored as texts without terms; a score
    at the threshold goes; ids make no difference, and repeated rows fare alike."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the smallest doc_id. Null doc_ids
    and blank texts stay; of rows that repeat a doc_id one stays."""
    return neardup.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, with or without a doc_id. Null and blank texts hold none; repeated rows
    fare alike; items without words match nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; all documents stay, with or without a doc_id. Null and blank texts stay as
    they are; of spans that overlap the first, then the longest, is replaced; repeated rows fare alike."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes. Null and blank texts have no words; a null source is a source; repeated rows are
    documents of their own."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]
#: Training, register estimates and random rounding have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
