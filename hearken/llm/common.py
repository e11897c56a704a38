"""What the operators of this subpackage share: tables, scratch tables, folds of labelled rows, Arrow helpers."""

from __future__ import annotations

import atexit
import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (app := spark.sparkContext.applicationId) not in _local:
        _local[app] = tempfile.mkdtemp(prefix="hearken-")
    return f"file://{_local[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._hearken_path = path
    return out


def drop_written(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_hearken_path", None):
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def sampled(key: Column, rate: Column | float, seed: str) -> Column:
    """Whether a row is in a sample at this rate; the same rows on every run."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < rate * 1_000_000


#: Rows of a table that is broadcast at most; it holds ids, hashes or short lists of them, so that this is some ten MB.
FEW_ROWS = 100_000


def few(table: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it has FEW_ROWS at most; a larger one is shuffled."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


class Store(dict):
    """What a Python worker keeps for its next tasks: what comes first, about `limit` bytes at most."""

    _all: list[Store] = []

    def __init__(self, owner: str, limit: int = 48 << 20):
        super().__init__()
        self.owner, self.limit, self.size = owner, limit, 0
        Store._all.append(self)

    def keep(self, key, value, size: int) -> None:
        """size: bytes of key and value, without what any entry takes."""
        if self.size < self.limit:
            self.size += size + 200
            self[key] = value

    def keep_all(self, found: dict[str, bytes]) -> None:
        """Texts and bytes."""
        if self.size < self.limit:
            self.size += sum(map(len, found)) + sum(map(len, found.values())) + 280 * len(found)
            self.update(found)


def only(owner: str) -> None:
    """Empties the stores of the worker that other operators have filled."""
    for store in Store._all:
        if store.owner != owner and store:
            store.clear()
            store.size = 0


def by_slices(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows at most, which hold about so many bytes of text at most unless one row has more."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 256) -> DataFrame:
    """f over slices of Arrow batches; it returns columns by name, in the order of the schema."""

    def run(batches):
        for batch in batches:
            for part in by_slices(batch, rows):
                yield pa.RecordBatch.from_pydict(f(part))

    return df.mapInArrow(run, schema)


def id_splits(df: DataFrame, column: str, rows_per_bucket: int = 2048, most: int = 16384) -> list:
    """Values that cut a numeric column into ranges of about as many rows each; most bounds what the driver gets."""
    n = df.filter(F.col(column).isNotNull()).count()
    buckets = min(most, max(1, n // rows_per_bucket))
    if buckets == 1:
        return []
    cuts = df.select(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 8 * buckets).alias("cuts")).first()["cuts"]
    return sorted(set(cuts))


def literal_array(values: list, kind: str) -> Column:
    """An array of numbers as one literal, however many there are; kind is the type of its elements."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def id_bucket(column: Column, splits: list, kind: str = "long") -> Column:
    """Number of the range that a value falls in; nulls go to the first. kind is the column's type.

    The splits are searched in two steps, among every width-th of them and then among the width that follow it, so that
    a row costs about two square roots of their number."""
    if not splits:
        return F.lit(0)
    width = math.isqrt(len(splits) - 1) + 1
    groups = [splits[i : i + width] for i in range(0, len(splits), width)]
    reached = lambda cuts: F.size(F.filter(cuts, lambda cut: cut <= column))
    group = reached(literal_array([g[0] for g in groups], kind)) - 1
    inside = F.get(literal_array(groups, f"array<{kind}>"), group)
    return F.coalesce(F.when(group < 0, 0).otherwise(group * width + reached(inside)), F.lit(0))
