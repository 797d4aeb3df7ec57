"""Pipeline stages over documents: each takes (spark, docs, sf_dir) and returns rows with the columns of documents.

All keep columns beyond those of documents, give an empty table for an empty one, and take null texts as empty ones, which
no stage drops for being empty. Repeated rows are judged alike; near_dedup keeps one of them. Rows without doc_id have no
labels and pass like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as leaks
from . import mixing, pii, simhash
from . import quality as trusted
from .shared import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return trusted.classify(docs, table(spark, sf_dir, "labels")).where("accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by SimHash, and beyond its distance by bands; each pair is compared exactly."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return _counted(leaks.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, **options) -> DataFrame:
    """Documents sampled to the target mixture, with their margins and probability."""
    return mixing.mix(docs, **{"targets": mixing.TARGETS} | options).where("kept").drop("kept")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, after their texts changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
