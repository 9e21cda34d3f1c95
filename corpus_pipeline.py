"""Corpus pipeline: documents to packed training sequences, five stages, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. ``n_chars`` follows the
text where a stage shortens it. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from frayline.llm.common import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    return quality_rules.without_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, also where rows repeat, share an id or have none."""
    return jaccard_join.one_row_of_each_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go, and documents that consist of nothing else."""
    return _counted(docs, substring_dedup.without_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that hardly hold anything else."""
    return _counted(docs, decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind)).select(*before.columns)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]
# the quality classifier has no SQL; tests/llm holds the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
