"""The text operators in a row: from raw documents to packed training sequences.

Each stage works on all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewatch.llm import mixing, neardup, packing, privacy, quality
from casewatch.llm.tokens import default_path
from casewatch.session import stage


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their language and source."""
    return quality.kept_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their personal data."""
    return privacy.redacted_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, cap=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return packing.pack(docs, default_path(), end_id=2, size=4096)


STAGES = [
    ("quality_rules", passing),
    ("near_duplicates", distinct),
    ("personal_data", private),
    ("source_mix", mixed),
    ("packing", packed),
]
ORACLE_SQL = None  # thresholds, trees and token ids have no SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
