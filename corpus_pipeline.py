"""Training-data pipeline over ``documents``: five stages, each one corpus operator.

Each stage's rows are written as Parquet and read again as the next one's documents.  A stage sets
the session's batches for Python workers and scans down to ``common.BATCHES`` and leaves them so,
since whoever writes its rows runs its last steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import common, decontam, packing, simhash, substring
from feedloom.llm import toxicity as severity


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects."""
    return severity.accepted(docs, common.table(spark, sf_dir, "labels"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return simhash.one_of_each(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too."""
    return substring.without_repeats(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents that are left."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Neither the fitted model nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = common.materialize(step(spark, docs, sf_dir), name)
    return docs
