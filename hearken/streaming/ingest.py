"""Incremental intake of recogniser outputs: a file stream that feeds cluster counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators.scoring import clusters


def stream_outcomes(spark: SparkSession, path: str, manifest: DataFrame, schema: str = "review_id string, model string, hypothesis string") -> DataFrame:
    """A streaming DataFrame of (model, cohort) totals over hypotheses that arrive as JSON lines, joined to a static manifest
    (review_id, cohort, dialect_units, plain_units). Run it in update or complete mode."""
    arrived = spark.readStream.schema(schema).json(path)
    matched = arrived.join(manifest, "review_id")
    counted = clusters(matched.withColumn("review_id", F.concat_ws("\t", "model", "review_id")))
    counted = counted.withColumn("model", F.substring_index("review_id", "\t", 1))
    return counted.groupBy("model", "cohort").agg(*[F.sum(c).alias(c) for c in ("dialect_total", "dialect_error", "plain_total", "plain_error")], F.count(F.lit(1)).alias("clusters"))
