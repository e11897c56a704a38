"""A corpus pipeline of five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearken.llm import language_id, mixing, near_dup, pieces, secret_scan
from hearken.llm.common import written

STAGES = [
    ("language_id", language_id.stage),
    ("near_dup", near_dup.stage),
    ("secrets", secret_scan.stage),
    ("mixing", mixing.stage),
    ("pieces", pieces.stage),
]

#: No SQL: the first stage is a trained model. tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
