"""The queries of this subpackage: each operator applied, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import chat, decontaminate, mixing, neardup, phrases, pii, quality, repair, secrets, suffix, tokens, toxicity, warc
from scoreloom.llm.oracles import OP8_SQL, OP13_SQL

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op9_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digest_examples(chat.prefix_target_examples(turns.unionByName(extra)), in_order=True)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


def op11_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(_read(spark, sf_dir, "conversations")))


def op12_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the vocabulary files of public tokenizers are

    return tokens.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


_QUERIES = (
    op1_pii_boosting,
    op2_minhash_near_dedup,
    op3_simhash_decontamination,
    op4_warc_normaliser,
    op5_secret_ownership,
    op6_toxicity_fm,
    op7_pivotal_mixing,
    op8_quality_cascade,
    op9_prefix_target_chat,
    op10_suffix_array_dedup,
    op11_trie_repair,
    op12_pretoken_counts,
    op13_phrase_mining,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_cascade": OP8_SQL, "op13_phrase_mining": OP13_SQL}
