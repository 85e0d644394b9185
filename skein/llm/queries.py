"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, extract, langid, ngram_join, oracle, packing, quality, suffix_dedup, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_read(spark, sf_dir, "documents")).drop("rid")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_read(spark, sf_dir, "documents"), PIECES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digest(chat.windows(turns.unionByName(own)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.report(_read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(_read(spark, sf_dir, "documents"), VOCABULARY))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), VOCABULARY)


QUERIES = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_decontamination, op3_language_id, op4_suffix_dedup, op5_chat_formatting, op6_html_extraction, op7_quality_rules, op8_packing, op9_toxicity, op10_token_counts)
}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": oracle.DECONTAMINATION, "op7_quality_rules": oracle.QUALITY}
