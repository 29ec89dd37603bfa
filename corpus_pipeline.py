"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as Parquet, and all but the last return the columns of ``documents``.
SQL cannot tell the rows of the language, near-duplicate, secrets and packing stages, so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` holds the stages against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.langid import with_language
from scanloom.llm.minhash import without_near_duplicates
from scanloom.llm.mixing import mixed_documents
from scanloom.llm.packing import packed
from scanloom.llm.secret_scan import mask_secrets
from scanloom.llm.store import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, ``lang`` set to it; texts that are null or without a letter go."""
    return with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and ``n_chars`` counted anew."""
    kind = docs.schema["n_chars"].dataType
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packed(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
