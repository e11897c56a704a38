"""Samples and selections that do not depend on the order or partitioning of their input: hashes decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.functions.text import bound


def sample_key(seed: int, key: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 256)


def stratified(df: DataFrame, cell: list[str], key: str, n: int, seed: int = 119) -> DataFrame:
    """Up to n rows of each cell, all of a smaller one.

    Ranks are first taken in 64 hash buckets of a cell, n rows of each at most, so that a cell that holds most rows is
    not sorted in one task."""
    h = sample_key(seed, key)
    rows = df.withColumn("_h", h).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell, "_part").orderBy("_h", key))).filter(F.col("_r") <= n)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("_h", key))).filter(F.col("_r") <= n)
    return best.drop("_h", "_part", "_r")


def stratified_by_labels(df: DataFrame, cell: list[str], labels: str, key: str, n: int, seed: int = 119) -> DataFrame:
    """A row is in a cell for each of its labels (an array); up to n of each cell, and each row once in the union."""
    exploded = df.select(*cell, key, F.explode(F.array_distinct(labels)).alias("_label"))
    chosen = stratified(exploded, [*cell, "_label"], key, n, seed).select(key).distinct()
    return df.join(chosen, key, "left_semi").dropDuplicates([key])


def round_robin(df: DataFrame, cohort: str, speaker: str, key: str, per_cohort: int, most_per_speaker: int) -> DataFrame:
    """Per cohort, the first row of every speaker, then the second, and so on until per_cohort rows; `taken` is their order.

    Only the rounds that are needed are ranked together: per_cohort rows of each round at most."""
    own = Window.partitionBy(cohort, speaker).orderBy(key)
    rows = df.withColumn("_round", F.row_number().over(own)).filter(F.col("_round") <= most_per_speaker)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(speaker), F.lit(64)))
    near = rows.withColumn("_near", F.row_number().over(Window.partitionBy(cohort, "_bucket").orderBy("_round", speaker))).filter(F.col("_near") <= per_cohort)
    return near.withColumn("taken", F.row_number().over(Window.partitionBy(cohort).orderBy("_round", speaker))).filter(F.col("taken") <= per_cohort).drop("_round", "_bucket", "_near")


def greedy_quota(df: DataFrame, key: str, cohort: str, labels: str, position: str, cohorts: list[str], names: list[str], most: int, *, bound: int = 100_000) -> DataFrame:
    """(key, selection_rank): for each cohort and label in order the next rows that were not taken before, a share of most
    each, then rows in order until there are `most`.

    The choice of a cell depends on those before it, so it is made on the driver, over no more rows than can matter: of
    each cell, and of all rows, the first ones. Their number has a bound that is checked."""
    share = max(1, most // (len(cohorts) * len(names)))
    reach = most + share * len(cohorts) * len(names)
    if reach * (len(cohorts) * len(names) + 1) > bound:
        raise ValueError("the selection is too large for the driver")
    at = F.col(position).alias("_at")
    cells = df.filter(F.col(cohort).isin(*cohorts)).select(key, at, F.col(cohort).alias("_c"), F.explode(F.array_distinct(labels)).alias("_l")).filter(F.col("_l").isin(*names))
    parts = [cells.filter((F.col("_c") == c) & (F.col("_l") == n)).orderBy("_at").limit(reach).select("_c", "_l", key, "_at") for c in cohorts for n in names]
    all_rows = df.select(F.lit(None).cast("string").alias("_c"), F.lit(None).cast("string").alias("_l"), key, at).orderBy("_at").limit(reach)
    for p in parts:
        all_rows = all_rows.unionByName(p)
    found: dict = {}
    for r in sorted(all_rows.collect(), key=lambda r: r["_at"]):
        found.setdefault((r["_c"], r["_l"]), []).append(r[key])
    chosen: list = []
    seen: set = set()
    for c in cohorts:
        for n in names:
            fresh = [k for k in found.get((c, n), []) if k not in seen][:share]
            chosen += fresh
            seen.update(fresh)
    for k in found.get((None, None), []):
        if len(chosen) >= most:
            break
        if k not in seen:
            chosen.append(k)
            seen.add(k)
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(chosen[:most])], f"{key} {kind}, selection_rank int")


def primary_label(df: DataFrame, keys: list[str], labels: str, out: str = "primary") -> DataFrame:
    """Each row's most frequent label, of equally frequent ones the first; labels is an array in order. Rows without a label
    give none. The labels are sorted and their runs counted inside the row, without a shuffle."""
    known = F.filter(F.transform(labels, lambda x, i: F.struct(x.alias("l"), i.alias("p"))), lambda x: x["l"].isNotNull())

    def best(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i)["l"] != F.get(s, i - 1)["l"]))
        run = lambda b: F.transform(b, lambda at, j: F.struct((F.coalesce(F.get(b, j + 1), F.size(s)) - at).alias("n"), (-F.get(s, at)["p"]).alias("p"), F.get(s, at)["l"].alias("l")))
        return F.array_max(bound(starts, run))["l"]

    return df.filter(F.size(F.array_compact(labels)) > 0).select(*keys, bound(F.array_sort(known), best).alias(out))


def mode_of(df: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that with the smallest order."""
    each = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    return each.orderBy(F.desc("n"), "_o").limit(1).select(column, "n")


def by_status(df: DataFrame, column: str, statuses: tuple, *keys: str) -> DataFrame:
    """Rows with one of the statuses, in their order, then by keys."""
    ranked = F.array_position(F.array(*map(F.lit, statuses)), F.col(column))
    return df.filter(F.col(column).isin(*statuses)).orderBy(ranked, *keys)
