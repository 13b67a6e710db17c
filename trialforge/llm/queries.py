"""Queries opN_<name> over the whole documents table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import alignment, counts, mixing, neardup, packing, pii, quality, rules, substring, token_files, tries, webp
from trialforge.llm.common import documents, written


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=3, threshold="0.85")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.suffix_dedup(documents(spark, sf_dir), keep_first=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(token_files.write_tokens(documents(spark, sf_dir)))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = {f"rate_{name}": F.round(f"rate_{name}", 9) for name in rules.RULES}
    return rules.quality_rules(documents(spark, sf_dir)).withColumns(rates)


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(written(webp.encode_media(documents(spark, sf_dir)), "media"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.conversations(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(documents(spark, sf_dir))


OPERATORS = (
    op1_minhash_near_dedup,
    op2_best_fit_packing,
    op3_quality_classifier,
    op4_suffix_array_dedup,
    op5_token_files,
    op6_source_mixing,
    op7_substring_dedup,
    op8_host_quality_rules,
    op9_lossless_webp,
    op10_contextual_pii,
    op11_token_alignment,
    op12_prefix_trie,
    op13_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {op6_source_mixing.__name__: mixing.ORACLE, op8_host_quality_rules.__name__: rules.ORACLE, op12_prefix_trie.__name__: tries.ORACLE}
