"""A training-data pipeline: five operators of harborlight.llm, one after another, over whole documents.

Defined cases, in every stage: documents may have further columns of any names, which pass through; a null text, or one
without a letter, goes in the first stage, and what is empty after line dedup in the second; a null doc_id stands for a
document of its own, first in order; repeated rows are one document from line dedup on, and one stays after the third
stage; texts of any length are worked on whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import language_id, line_dedup, minhash_dedup, mixing, packing


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified and not rejected."""
    return language_id.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those of which nothing is left go. n_chars follows the text."""
    left = line_dedup.keep_first_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.keep_one(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of domains, languages and sources, once for each epoch in which they are given."""
    return mixing.keep_mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed_to_weights),
    ("packing", packed),
]

#: Trained language identification and learnt subword ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
