"""Corpus preparation in stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm import stages
from lumenweave.llm.shared import table, written

STAGES = [
    ("quality classifier", stages.quality),
    ("simhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontaminate),
    ("pii", stages.redact),
    ("mixing", stages.mix_sources),
]

#: Trained models and component search are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
