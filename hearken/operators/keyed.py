"""Rows by key: the last of repeated ones, and rows in the order of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a row stood: struct of file and line, as sources.io.read_jsonl_numbered gives it.
LINE = "_line"


def last_of(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key without nulls: of several the one of the last file and line. Rows of a table without LINE have
    no order; of those the greatest by its JSON stays, so that reruns agree. LINE is not in the result."""
    others = [c for c in df.columns if c not in (*keys, LINE)]
    order = F.col(LINE) if LINE in df.columns else F.to_json(F.struct(*df.columns))
    rows = df.dropna(subset=list(keys)).groupBy(*keys)
    if not others:
        return rows.agg(F.lit(1).alias("_n")).drop("_n")
    return rows.agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*").select(*[c for c in df.columns if c != LINE])


def in_order(rows: DataFrame, selection: DataFrame, key: str, rank: str) -> DataFrame:
    """The rows that a selection (key, rank) names, with rank, in its order; a name without a row is an error. Of repeated rows
    the last counts."""
    found = selection.select(key, rank).join(last_of(rows, key).withColumn("_there", F.lit(True)), key, "left")
    there = F.when(F.col("_there").isNull(), F.raise_error(F.format_string("no row for %s", F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return found.filter(there).drop("_there").orderBy(rank)
