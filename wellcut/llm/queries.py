"""Queries and SQL of this subpackage, registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellcut.llm import byte_bpe, licenses, line_dedup, near_dup, packing, quality_model, quality_rules, token_counts, toxicity, vector_dup
from wellcut.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def vocabulary() -> str:
    """The installed vocabulary file of the production runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "n_tokens")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = licenses.scan(docs, licenses.train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licenses.family"))), ",")
    return rows.select("doc_id", "n_paragraphs", "n_licenses", families.alias("families"), F.round(F.coalesce(F.array_max("licenses.probability"), F.lit(0.0)), 4).alias("best"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_vector_dup": op2_vector_dup,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dup": op4_near_dup,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_licenses": op10_licenses,
}
