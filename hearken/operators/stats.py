"""Statistics of clustered two-by-two data (dialect_total, dialect_error, plain_total, plain_error for each cluster).

Everything is aggregation over the clusters by group, with built-in expressions, but for the draws of `bootstrap` and
`permutation_test`, which NumPy makes. Undefined values are null."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def _div(a, b) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: a series below 2, a continued fraction from there on."""
    small = F.least(x, F.lit(2.0))
    begin = F.struct(small.alias("t"), small.alias("s"))

    def term(a: Column, n: Column) -> Column:
        t = a["t"] * 2 * small * small / (2 * n + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    series = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-small * small) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), begin, term, lambda a: a["s"])
    large = F.greatest(x, F.lit(2.0))
    q = 1 / (2 * large * large)
    fraction = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), F.lit(1.0), lambda k, n: 1 + n * q / k)
    return F.when(x < 2, series).otherwise(F.exp(-large * large) / (large * F.lit(math.sqrt(math.pi)) * fraction))


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def totals(clusters: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("dialect_total", "dialect_error", "plain_total", "plain_error")]
    return clusters.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("clusters"))


def rates(clusters: DataFrame, *by: str) -> DataFrame:
    """Error rates, their difference and ratio, the pooled odds ratio."""
    t = totals(clusters, *by)
    d, p = _div("dialect_error", "dialect_total"), _div("plain_error", "plain_total")
    odds = _div(F.col("dialect_error") * (F.col("plain_total") - F.col("plain_error")), F.col("plain_error") * (F.col("dialect_total") - F.col("dialect_error")))
    return t.select("*", d.alias("dialect_rate"), p.alias("plain_rate"), (d - p).alias("difference"), _div(d, p).alias("ratio"), odds.alias("odds_ratio"))


def two_proportion(clusters: DataFrame, *by: str) -> DataFrame:
    """Pooled two-proportion z test."""
    r = rates(clusters, *by)
    pooled = _div(F.col("dialect_error") + F.col("plain_error"), F.col("dialect_total") + F.col("plain_total"))
    se = F.sqrt(pooled * (1 - pooled) * (_div(1, "dialect_total") + _div(1, "plain_total")))
    z = _div("difference", se)
    return r.select(*by, "difference", se.alias("naive_se"), z.alias("z"), two_sided_p(z).alias("p"))


def wald_interval(clusters: DataFrame, *by: str) -> DataFrame:
    """95 % interval of the odds ratio; (0, 0) where a cell is empty."""
    r = rates(clusters, *by)
    cells = (F.col("dialect_error"), F.col("dialect_total") - F.col("dialect_error"), F.col("plain_error"), F.col("plain_total") - F.col("plain_error"))
    se = F.sqrt(sum((_div(1, c) for c in cells[1:]), _div(1, cells[0])))
    full = F.least(*cells) > 0
    edge = lambda sign: F.when(full, F.exp(F.ln("odds_ratio") + sign * Z95 * se)).otherwise(0.0)
    return r.select(*by, F.coalesce("odds_ratio", F.lit(0.0)).alias("odds_ratio"), edge(-1).alias("lower"), edge(1).alias("upper"))


def mantel_haenszel(clusters: DataFrame, *by: str) -> DataFrame:
    """Odds ratio stratified by cluster, with its Robins-Breslow-Greenland variance: one aggregation of sums."""
    a, b = F.col("dialect_error"), F.col("dialect_total") - F.col("dialect_error")
    c, d = F.col("plain_error"), F.col("plain_total") - F.col("plain_error")
    n = (F.col("dialect_total") + F.col("plain_total")).cast("double")
    r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
    sums = {"r": r, "s": s, "pr": p * r, "cross": p * s + q * r, "qs": q * s}
    t = clusters.filter(n > 0).groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    sound = (F.col("r") > 0) & (F.col("s") > 0)
    se = F.sqrt(_div("pr", 2 * F.col("r") * F.col("r")) + _div("cross", 2 * F.col("r") * F.col("s")) + _div("qs", 2 * F.col("s") * F.col("s")))
    odds = _div("r", "s")
    z = F.ln(odds) / se
    keep = lambda x: F.when(sound, x)
    return t.select(*by, keep(odds).alias("mh_odds_ratio"), keep(se).alias("mh_log_se"), keep(F.exp(F.ln(odds) - Z95 * se)).alias("mh_lower"), keep(F.exp(F.ln(odds) + Z95 * se)).alias("mh_upper"), keep(z).alias("mh_z"), keep(two_sided_p(z)).alias("mh_p"))


def permutation_null(clusters: DataFrame, *by: str) -> DataFrame:
    """Exact mean and deviation of the rate difference when labels are permuted within clusters; `informative` clusters
    have both labels and both outcomes."""
    k, m = F.col("dialect_total").cast("double"), F.col("plain_total").cast("double")
    n, e = k + m, F.col("dialect_error") + F.col("plain_error")
    mean = F.when(n > 0, k * e / n).otherwise(0.0)
    var = F.when(n > 1, k * (e / n) * (1 - e / n) * (n - k) / (n - 1)).otherwise(0.0)
    t = clusters.groupBy(*by).agg(
        F.sum(mean).alias("mean"), F.sum(var).alias("var"), F.sum(e).alias("errors"), F.sum(k).alias("k"), F.sum(m).alias("m"),
        F.sum("dialect_error").alias("observed"), F.count_if((k > 0) & (m > 0) & (e > 0) & (e < n)).alias("informative"),
    )
    null = _div("mean", "k") - _div(F.col("errors") - F.col("mean"), "m")
    seen = _div("observed", "k") - _div(F.col("errors") - F.col("observed"), "m")
    sd = F.sqrt("var") * (_div(1, "k") + _div(1, "m"))
    return t.select(*by, "informative", seen.alias("observed_difference"), null.alias("null_mean"), sd.alias("null_sd"), _div(null, seen).alias("composition_share"))


def _draw(seed: str, draw: Column, slot: Column) -> Column:
    """A number of 60 bits that depends on seed, draw and slot alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), draw.cast("string"), slot.cast("string"))), 1, 15), 16, 10).cast("long")


def bootstrap_draws(clusters: DataFrame, key: str, columns: list[str], draws: int, seed: str = "bootstrap", *, most_clusters: int = 1_000_000) -> DataFrame:
    """(draw, sums of columns) of resampled clusters: n of n with replacement, by counter-based numbers.

    The clusters are numbered by key. They are a table of outcomes by utterance, not of texts; their number has a bound
    that is checked, since numbering them needs one ordering."""
    from pyspark.sql.window import Window

    n = clusters.count()
    if n > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters")
    spark = clusters.sparkSession
    numbered = clusters.select(*columns, (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("_i"))
    if n == 0:
        return spark.createDataFrame([], f"draw long, {', '.join(f'{c} long' for c in columns)}")
    slots = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picked = slots.withColumn("_i", F.pmod(_draw(seed, F.col("draw"), F.col("_slot")), F.lit(n)))
    return picked.join(F.broadcast(numbered), "_i").groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def _counts(clusters: DataFrame, key: str, columns: list[str], most_clusters: int) -> np.ndarray:
    """The columns of all clusters in the order of the key, on the driver; the number of clusters has a bound that is checked."""
    if clusters.count() > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters")
    table = clusters.select(key, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns]).toArrow()
    table = table.sort_by([(c, "ascending") for c in table.column_names])
    return np.stack([table[c].to_numpy() for c in columns], axis=1)


def _each_draw(spark, draws: int, seed: str, columns: list[str], sums: Callable[[np.random.Generator], np.ndarray]) -> DataFrame:
    """(draw, columns) of sums(generator), whose numbers depend on seed and draw alone."""
    start = int.from_bytes(hashlib.md5(seed.encode()).digest()[:8], "big")

    def run(batches):
        for b in batches:
            got = np.array([sums(np.random.default_rng([start, d])) for d in b["id"].to_pylist()], dtype=np.int64).reshape(-1, len(columns))
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(got[:, i]) for i in range(len(columns))]], names=["draw", *columns])

    parts = max(1, min(draws, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, draws, 1, parts).mapInArrow(run, ", ".join(f"{c} long" for c in ["draw", *columns]))


def bootstrap(clusters: DataFrame, key: str = "review_id", draws: int = 10_000, seed: str = "bootstrap", *, most_clusters: int = 1_000_000) -> DataFrame:
    """One row: 95 % intervals of both rates, difference, ratio and odds ratio, the standard error of the difference, and the
    share of draws at or below no difference. Each draw takes n of the n clusters with replacement."""
    columns = ["dialect_total", "dialect_error", "plain_total", "plain_error"]
    table = _counts(clusters, key, columns, most_clusters)
    n = len(table)
    drawn = _each_draw(clusters.sparkSession, draws if n else 0, seed, columns, lambda rng: np.bincount(rng.integers(0, n, n), minlength=n) @ table)
    each = rates(drawn, "draw")
    sides = F.array(F.lit(0.025), F.lit(0.975))
    names = ("dialect_rate", "plain_rate", "difference", "ratio", "odds_ratio")
    return each.agg(*[F.percentile(c, sides).alias(f"{c}_ci") for c in names], F.stddev_samp("difference").alias("difference_se"), F.avg((F.col("difference") <= 0).cast("double")).alias("at_or_below_zero"))


def bootstrap_loss(clusters: DataFrame, key: str = "review_id", draws: int = 10_000, seed: str = "loss") -> DataFrame:
    """Interval of a loss rate, of clusters with `hits` and `total`."""
    drawn = bootstrap_draws(clusters, key, ["hits", "total"], draws, seed).select(_div("hits", "total").alias("loss"))
    return drawn.agg(F.percentile("loss", F.array(F.lit(0.025), F.lit(0.975))).alias("loss_ci"), F.stddev_samp("loss").alias("loss_se"))


def cohort_contrast(clusters: DataFrame, one: str, two: str, key: str = "review_id", draws: int = 10_000, seed: str = "contrast") -> DataFrame:
    """Difference of the dialect error rates of two cohorts, resampled apart; `comparable` is false where one has no unit."""
    arms = [rates(bootstrap_draws(clusters.filter(F.col("cohort") == c), key, ["dialect_total", "dialect_error", "plain_total", "plain_error"], draws, f"{seed}-{c}"), "draw").select("draw", F.col("dialect_rate").alias(f"r{i}")) for i, c in enumerate((one, two))]
    seen = clusters.filter(F.col("cohort").isin(one, two)).groupBy().agg(*[_div(F.sum(F.when(F.col("cohort") == c, F.col("dialect_error"))), F.sum(F.when(F.col("cohort") == c, F.col("dialect_total")))).alias(f"rate_{i}") for i, c in enumerate((one, two))])
    gap = arms[0].join(arms[1], "draw").select((F.col("r0") - F.col("r1")).alias("gap"))
    gap = gap.agg(F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975))).alias("difference_ci"), F.avg((F.col("gap") <= 0).cast("double")).alias("crossing"))
    return seen.select("rate_0", "rate_1", (F.col("rate_0") - F.col("rate_1")).alias("difference"), (F.col("rate_0").isNotNull() & F.col("rate_1").isNotNull()).alias("comparable")).join(F.broadcast(gap), F.lit(True))  # one row each


def marked_contrast(outcomes: DataFrame, key: str = "review_id", draws: int = 10_000, seed: str = "marked", *, least_spans: int = 10, least_clusters: int = 5) -> DataFrame:
    """One row: strict loss of the dialect-marked spans less that of the others, of outcomes (key, match_type,
    dialect_marked) with phantom labels left out; each arm's utterances are resampled apart.

    `comparable` is false, and rates of the missing arm are null, where an arm has no span. `underpowered` says that the
    marked arm has fewer than least_spans spans or least_clusters utterances."""
    rows = outcomes.filter("match_type <> 'phantom_label'").select(key, "match_type", F.coalesce("dialect_marked", F.lit(False)).alias("_m"))
    each = rows.groupBy(key, "_m").agg(F.count_if(F.col("match_type") == "absent").alias("hits"), F.count(F.lit(1)).alias("total"))
    of = lambda marked, column: F.coalesce(F.sum(F.when(F.col("_m") == marked, F.col(column))), F.lit(0))
    seen = each.agg(F.count_if("_m").alias("marked_clusters"), of(True, "total").alias("marked_spans"), of(False, "total").alias("plain_spans"), of(True, "hits").alias("_a"), of(False, "hits").alias("_b"))
    seen = seen.withColumns({"marked_loss": _div("_a", "marked_spans"), "plain_loss": _div("_b", "plain_spans")}).withColumn("difference", F.col("marked_loss") - F.col("plain_loss"))
    arms = [bootstrap_draws(each.filter(F.col("_m") == m), key, ["hits", "total"], draws, f"{seed}-{m}").select("draw", _div("hits", "total").alias(f"_{m}")) for m in (True, False)]
    gap = arms[0].join(arms[1], "draw").agg(F.percentile(F.col("_True") - F.col("_False"), F.array(F.lit(0.025), F.lit(0.975))).alias("difference_ci"))
    out = seen.drop("_a", "_b").withColumn("comparable", (F.col("marked_spans") > 0) & (F.col("plain_spans") > 0))
    out = out.withColumn("underpowered", (F.col("marked_spans") < least_spans) | (F.col("marked_clusters") < least_clusters)).join(F.broadcast(gap), F.lit(True))  # one row each
    return out.withColumn("crosses_zero", (F.get("difference_ci", F.lit(0)) <= 0) & (F.get("difference_ci", F.lit(1)) >= 0))


def permutation_test(units: DataFrame, key: str = "review_id", draws: int = 20_000, seed: str = "permutation", *, most_clusters: int = 1_000_000) -> DataFrame:
    """Monte Carlo test of the rate difference: labels move within clusters. units: key, is_dialect, is_error, one row each.

    When the labels of a cluster are permuted, the errors among its k dialect units are hypergeometric; each draw takes one such
    number for every cluster. A draw is extreme when its difference is as far from 0 as the observed one."""
    counts = units.groupBy(key).agg(F.count_if("is_error").alias("bad"), F.count_if(~F.col("is_error")).alias("good"), F.count_if("is_dialect").alias("k"), F.count_if(F.col("is_dialect") & F.col("is_error")).alias("seen"))
    table = _counts(counts, key, ["bad", "good", "k", "seen"], most_clusters)
    bad, good, k, seen = table.T
    errors, dialect, plain = int(bad.sum()), int(k.sum()), int((bad + good - k).sum())
    difference = lambda e: _div(e, F.lit(dialect)) - _div(F.lit(errors) - e, F.lit(plain))
    drawn = _each_draw(units.sparkSession, draws, seed, ["e"], lambda rng: rng.hypergeometric(bad, good, k).sum())
    joined = drawn.select(difference(F.col("e")).alias("d"), difference(F.lit(int(seen.sum()))).alias("observed"))
    extreme = F.count_if(F.abs("d") >= F.abs("observed") - 1e-12)
    return joined.agg(F.first("observed").alias("observed"), F.avg("d").alias("null_mean"), F.stddev_samp("d").alias("null_sd"), ((extreme + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def design_effect(bootstrap_row: DataFrame, naive: DataFrame) -> DataFrame:
    """Squared ratio of the clustered to the naive standard error."""
    return bootstrap_row.select("difference_se").join(F.broadcast(naive.select("naive_se")), F.lit(True)).select(F.pow(_div("difference_se", "naive_se"), 2).alias("design_effect"))
