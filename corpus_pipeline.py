"""Corpus pipeline: quality filter, near-dedup, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the
stage before it kept. All but the last return the columns of documents, and further columns of
their input under any names. Where a stage's verdicts join back to the texts, rows are carried
whole in one column and the key is (doc_id, hash of the text), so rows with null or repeated ids
keep apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import mixing, neardup, packing, pii, quality
from trialforge.llm.common import documents, keyed_rows, meet, written

#: Stages hold a classifier, hashed graphs and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (probability of quality below 0.3)."""
    vectors, net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, vectors, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies (five words, similarity 0.8); equal rows once."""
    first = neardup.near_duplicates(docs).where("first").select(F.col("key_id").alias("row_id"), F.col("text_hash").alias("row_hash")).distinct()
    kept = meet(keyed_rows(docs), first, ["row_id", "row_hash"], "left_semi")
    return kept.dropDuplicates(["row_id", "row_hash"]).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets for each span of personal data."""
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave out documents so that sources come to their targets.

    A document that ends a source's budget is cut to the words that fit.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of each document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("contextual_pii", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
