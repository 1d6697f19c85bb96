"""From raw documents to packed training sequences, in five stages.

Every stage is written as Parquet and read again by the next, so a lost executor never
costs more than the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagepath.llm import classifier, jaccard, packing, quality, secret_scan
from stagepath.llm.common import held_staging, table

#: The fitted models and the packing cannot be written in SQL; tests check them otherwise.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their host share."""
    return quality.clean(docs, held_staging(spark))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior chance of being good is at least a half."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"), held_staging(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one_of_each(docs, held_staging(spark))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a placeholder."""
    return secret_scan.redact(docs, held_staging(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in windows of 2048 tokens, a row per piece."""
    return packing.pack(docs, held_staging(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay."""
    staging, docs = held_staging(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.save(stage(spark, docs, sf_dir), name)
    return docs
