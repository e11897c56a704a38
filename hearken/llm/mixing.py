"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by hash to blocks. A source whose target is e times its size and a rest is drawn
e times whole and once in part: the blocks of the part are those that come first in a permutation, as far as the rest
goes; the block at its end is filled document by document, largest first, so that the words taken meet the target
within the size of a small document. The exact numbers of draws of all sources are split among the output shards by a
binary tree: each node deals half of its capacity to either child by a multivariate hypergeometric draw, so that the
quotas of the shards add up exactly and every shard is a uniform sample of the mix. The shards then take disjoint
ranges of the permuted draws, and are shuffled locally. Everything is decided by hashes and seeds: reruns agree.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import written

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK_WORDS, MOST_BLOCKS = 16384, 65536
SHARD_WORDS, MOST_SHARDS, MOST_SOURCES = 50_000, 65536, 100_000
#: Largest population that numpy draws from.
NUMPY_MOST = 10**9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple = WEIGHTS, cap: int = CAP) -> list[float]:
    """Each source's words: shares of the total by weight, none over cap times its size, the excess shared again."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], total
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if unit * w[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` things without replacement are of the `good` ones. Beyond numpy's largest population the number is
    found in the table of probabilities around the most likely one, each from its neighbour, to where they are under 1e-30 of it."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (good + 1) * (drawn + 1) // (good + bad + 2)))
    share = drawn / (good + bad)
    wide = 20 + int(12 * (good * share * (1 - share)) ** 0.5)
    up = np.arange(mode, min(high, mode + wide), dtype=float)
    down = np.arange(mode, max(low, mode - wide), -1, dtype=float)
    above = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    below = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    sums = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def splitting_tree(quotas: list[int], shards: int, seed: int = 7) -> np.ndarray:
    """(sources, shards) exact numbers of draws; rows add up to the quotas, and shards get equally many within one."""
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        a, b, here = todo.pop()
        if b - a == 1:
            out[:, a] = here
            continue
        mid = (a + b) // 2
        part = int(here.sum()) * (mid - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        # in the marginal way a source at a time, so that neither time nor memory grows with the quotas
        first, rest, want = np.zeros_like(here), int(here.sum()), part
        for k, n in enumerate(here.tolist()):
            rest -= n
            if n and want:
                take = hypergeometric(rng, n, rest, want)
                first[k] = take
                want -= take
        todo += [(a, mid, first), (mid, b, here - first)]
    return out


def nearest_subset(sizes: list[int], goal: int, fine: int = 1 << 16, most: int = 512) -> list[bool]:
    """Which of the sizes, largest first, to take so that they add up to nearly goal.

    Sizes are taken as long as they fit, until goal is within reach of the `most` smallest or under `fine`; the best sum of those
    is then found among all their sums.
    """
    keep, left, k = [False] * len(sizes), goal, 0
    while k < len(sizes) and (left > fine or len(sizes) - k > most):
        if sizes[k] <= left:
            keep[k] = True
            left -= sizes[k]
        k += 1
    if left <= 0 or k == len(sizes):
        return keep
    mask = (1 << min(2 * left + 1, left + max(sizes[k:]) + 1)) - 1
    sums = [1]
    for x in sizes[k:]:
        sums.append((sums[-1] | (sums[-1] << x)) & mask)
    low = (sums[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    high = sums[-1] >> left
    over = (high & -high).bit_length() - 1 if high else None
    at = low if over is None or left - low <= over else left + over
    for i in range(len(sizes) - 1, k - 1, -1):
        if not sums[i - k] >> at & 1:
            keep[i] = True
            at -= sizes[i]
    return keep


def plan_mix(docs: DataFrame, *, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, draws) for each row; draws is an array of the shards it goes to, one
    entry for each time that the mix takes it.

    The sizes of the sources meet on the driver: MOST_SOURCES bounds their number, and more raise an error. Null texts
    and texts without words have size 0; they count with each whole draw of their source and are never a part of one.
    Rows that share source, id and size are taken alike. A source without words has the target 0 and is not drawn.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "sized")
    rows = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["s"] for r in rows]
    goals = targets(sizes, weights, cap)
    table = []
    for r, s, t in zip(rows, sizes, goals, strict=True):
        whole = min(cap, int(t // s)) if s else 0
        table.append((r["source"], s, t, whole, max(0, round(t - whole * s)), max(1, min(MOST_BLOCKS, -(-s // BLOCK_WORDS)))))
    src = F.broadcast(spark.createDataFrame(table, "source string, source_size long, target double, whole int, rest long, blocks int"))  # MOST_SOURCES rows at most
    at = sized.join(src.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = at.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.col("blocks")).cast("int"))
    per = at.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))

    from pyspark.sql.window import Window

    # a window over a source's blocks, of which there are MOST_BLOCKS at most
    along = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit("permuted")), "block")
    per = per.withColumn("rank", (F.row_number().over(along) - 1).cast("int")).withColumn("upto", F.sum("words").over(along))
    per = per.withColumn("before", F.coalesce(F.lag("words").over(along), F.lit(0)))
    # 2: whole in the part; 1: the block at its end and the one after it, which are filled by documents
    begins = F.col("upto") - F.col("words")
    per = per.withColumn("state", F.when(F.col("upto") <= F.col("rest"), 2).when(begins - F.col("before") < F.col("rest"), F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0))
    per = written(per.withColumn("residual", F.col("rest") - begins), "mixed_blocks")

    order = {r["source"]: i for i, r in enumerate(rows)}
    drawn = {r["source"]: r for r in per.groupBy("source").agg((F.sum("whole") + F.count_if(F.col("state") > 0)).alias("n"), F.count(F.lit(1)).alias("filled")).collect()}
    quotas = [int(drawn[r["source"]]["n"]) if r["source"] in drawn else 0 for r in rows]
    shards = max(1, min(MOST_SHARDS, int(sum(goals)) // SHARD_WORDS, 4_000_000 // max(1, len(rows))))
    ends = splitting_tree(quotas, shards).cumsum(axis=1)
    # blocks that hold documents, which rank numbers: places are 0 to the quota less one, each once
    block_count = [drawn[r["source"]]["filled"] if r["source"] in drawn else 0 for r in rows]

    def to_shards(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for source, whole, rank, state in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                k = order[source]
                n = block_count[k]
                places = []
                for e in range(whole + (state > 0)):
                    step = next(x for x in range(n // 2 + 1 + 7 * e, 2 * n + 8 * e + 2) if gcd(x, n) == 1) if n > 1 else 1
                    # each whole draw has a permutation of its own; the part keeps the one that chose it
                    places.append(e * n + (rank if e == whole else (rank * step + 13 * e) % n))
                out.append(np.searchsorted(ends[k], places, side="right").tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32())), batch.column(4), batch.column(5)], names=["source", "block", "shards", "state", "residual"])

    dealt = per.select("source", "block", "whole", "rank", "state", "residual").mapInArrow(to_shards, "source string, block int, shards array<int>, state int, residual long")
    dealt = written(dealt, "dealt_blocks")
    ends_at = dealt.filter("state = 1")
    # two blocks of each source at most
    last = at.select("source", "block", "doc_id", "size").join(ends_at.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "residual"), (F.col("block") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    last = last.groupBy("source", "block", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("residual").alias("residual")).filter("size > 0")

    def fill(pdf):
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True])
        keep = nearest_subset((pdf["size"] * pdf["n"]).tolist(), int(pdf["residual"].max()))
        return pdf[keep][["source", "block", "doc_id", "size"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    picks = last.groupBy("source").applyInPandas(fill, f"source string, block int, doc_id {kind}, size long").withColumn("picked", F.lit(True))
    same = lambda a, b: a.eqNullSafe(b)
    dealt = dealt.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "shards", "state")
    picks = picks.select(F.col("source").alias("_ps"), F.col("block").alias("_pb"), F.col("doc_id").alias("_pd"), F.col("size").alias("_pz"), "picked")
    out = at.join(dealt, (F.col("block") == F.col("_b")) & same(F.col("source"), F.col("_s")))
    out = out.join(picks, (F.col("block") == F.col("_pb")) & same(F.col("source"), F.col("_ps")) & same(F.col("doc_id"), F.col("_pd")) & (F.col("size") == F.col("_pz")), "left")
    full = (F.col("state") == 2) | F.col("picked")
    draws = F.when((F.col("state") == 1) & F.col("picked").isNull(), F.slice("shards", 1, F.col("whole"))).otherwise(F.col("shards"))
    return out.withColumn("draws", F.when(F.coalesce(full, F.lit(False)), F.col("shards")).otherwise(draws)).select("doc_id", "source", "size", "source_size", "target", "draws")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), one row for each row of docs."""
    plan = plan_mix(docs.select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join(F.col("draws").cast("array<string>"), ",").alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: docs once for each time they are taken, by shard, shuffled within each. Documents that the
    mix does not take are not in it. Columns are those of docs and `mix_shard`."""
    plan = plan_mix(docs.select("doc_id", "source", "text")).dropDuplicates(["doc_id", "source", "size"])
    plan = plan.select(F.col("doc_id").alias("_mix_d"), F.col("source").alias("_mix_o"), F.col("size").alias("_mix_z"), F.col("draws").alias("_mix_draws"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_mix_d")) & F.col("source").eqNullSafe(F.col("_mix_o")) & (size == F.col("_mix_z")))
    rows = rows.select(*[docs[c] for c in docs.columns], F.posexplode("_mix_draws").alias("_mix_e", "mix_shard"))
    rows = rows.withColumn("_mix_k", F.xxhash64("doc_id", "_mix_e", "mix_shard"))
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "_mix_k").select(*docs.columns, "mix_shard")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all documents, as rows of docs: some come more than once, some not at all."""
    return mix(docs).select(*docs.columns)
