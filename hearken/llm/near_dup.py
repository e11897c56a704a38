"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are split at white space; the k-mers are shingles of five words, labelled by occurrence (the third copy of a
shingle in a text is another element than the first). Every one of TABLES sketches hashes the labelled shingles,
takes the PICKS smallest and keeps them in text order, so that it agrees for texts that share both shingles and their
order. Texts that agree in a sketch are candidates. A candidate is confirmed by the edit distance of the two word
sequences, by bit-parallel alignment inside the diagonal band that the threshold needs: the similarity is 1 less the distance over
the number of words of the longer text, and links reach THRESHOLD.

With a share e of the words replaced at random places, a shingle outlives it with probability s = (1 - e) ** 5, the texts
share j = s / (2 - s) of their shingles, and a sketch agrees with j ** 2. One of the 24 does with 0.99999 at 5 % of the words, 0.990
at 10 %, 0.87 at 15 % and 0.61 at 20 %, which is the very threshold; edits that stand together cost fewer shingles. As one
changed word of a short text leaves few shingles, texts under SHORT words are sketched by pairs of words too, and
those of up to TINY words, where one edit is the most that the threshold lets pass, meet by all their words but one, which
misses nothing.

Exact copies are collapsed by two hashes first. In each bucket of equal sketches every text is then compared with one text
of the bucket, which joins groups of copies in proportion to their size. In the buckets that still hold several components
all pairs of texts of different components are met, in pairs of blocks of bounded size. Before two texts are aligned, the
parities of their words' counts by hash are compared: an edit changes two of them at most, so that this loses nothing.
Null texts, texts without words and rows without an id are in no group; rows that share an id but not their text are
judged apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import Store, by_slices, drop_written, few, mapped, only, written
from hearken.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
TABLES, PICKS = 24, 2
#: Texts of fewer words are sketched by pairs of words; those of LONG words or more by shingles. Both, where a pair's texts
#: may stand on either side.
SHORT, LONG, TINY = 32, 26, 9
#: Texts of a bucket, and words of them, that are met with as many others at once.
BLOCK_TEXTS, BLOCK_WORDS = 4096, 1 << 20
#: Different texts that a task of what follows the sketches has at least.
TASK_TEXTS = 4000


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BY_PLACE = _multipliers(WORDS, 11)
_BY_TABLE = _multipliers(TABLES, 12)[:, None]
_PLUS = _multipliers(TABLES, 13)[:, None]
_BY_PICK = _multipliers(PICKS, 14)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hasher(Store):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        h = word_hash(word)
        self.keep(word, h, 40 + len(word))
        return h


#: One in each Python worker; pickled by name, not by value.
HASHES = Hasher("near_dup")


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(w: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each shingle of k words, in text order, from the words' hashes; of all words if they are fewer."""
    if len(w) < k:
        return _mix((w * _BY_PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += w[j : j + n] * _BY_PLACE[j]
    return _mix(out)


def with_occurrences(shingles: np.ndarray) -> np.ndarray:
    """Shingles labelled by their occurrence, counted from the start of the text."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return shingles
    at = np.arange(len(s))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(s), np.uint64)
    out[order] = s + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def order_sketch(labelled: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """TABLES bucket keys. A long text goes through in blocks, so that memory is bounded."""
    best_h = np.zeros((TABLES, 0), np.uint64)
    best_i = np.zeros((TABLES, 0), np.int64)
    for at in range(0, len(labelled), block):
        part = labelled[at : at + block]
        h = part[None, :] * _BY_TABLE + _PLUS
        h ^= h >> np.uint64(32)
        i = np.broadcast_to(np.arange(at, at + len(part)), h.shape)
        if best_h.shape[1]:
            h, i = np.concatenate([best_h, h], axis=1), np.concatenate([best_i, i], axis=1)
        if h.shape[1] > PICKS:
            pick = np.argpartition(h, PICKS - 1, axis=1)[:, :PICKS]
            h, i = np.take_along_axis(h, pick, 1), np.take_along_axis(i, pick, 1)
        best_h, best_i = h, i
    in_text = np.take_along_axis(best_h, np.argsort(best_i, axis=1), 1)
    return _mix((in_text * _BY_PICK[: in_text.shape[1]]).sum(axis=1, dtype=np.uint64) + _PLUS[:, 0])


def bucket_keys(w: np.ndarray) -> np.ndarray:
    """The keys of all buckets that a text of these words goes to, each once."""
    keys = []
    if len(w) >= LONG:
        keys.append(order_sketch(with_occurrences(shingle_hashes(w))))
    if len(w) < SHORT:
        keys.append(_mix(order_sketch(with_occurrences(shingle_hashes(w, 2))) + np.uint64(1)))
    if len(w) <= TINY:
        at = w * _mix(np.arange(1, len(w) + 1, dtype=np.uint64))  # place by place, so that all but one word add up at once
        later = w * _mix(np.arange(len(w), dtype=np.uint64))
        less = np.cumsum(at) - at + np.cumsum(later[::-1])[::-1] - later
        keys.append(_mix(np.append(less, at.sum(dtype=np.uint64)) + np.uint64(2)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def parities(w: np.ndarray) -> np.ndarray:
    """Whether the words in each class of hashes are odd in number, as bits; six classes or more for a word, so that few words share one."""
    size = 64
    while size < 6 * len(w):
        size *= 2
    odd = np.bincount((w & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def distance_within(a: list[str], b: list[str], most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, by bit-parallel columns of the band |i - j| <= most."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    if not m or not n:
        return max(m, n)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    k = min(most, max(m, n))
    # bit t of column j stands for row j - k + t; differences of neighbours, up and along, are bits
    full, bottom = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    up, down = full & ~((1 << k) - 1), 0
    score, along = min(m, k), 1 << (min(m, k) + k)
    for j, x in enumerate(b, 1):
        found = places.get(x, 0)
        same = (found >> (j - k - 1) if j > k else found << (k + 1 - j)) & full
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        if j + k <= m:
            score += not diagonal & bottom
        else:
            along >>= 1
            score += bool(right & along) - bool(left & along)
        shifted = (diagonal & full) >> 1
        up, down = left | (full & ~(shifted | right)), shifted & right
        up &= full
    return score if score <= most else None


def edits_allowed(n: int, m: int, threshold: float = THRESHOLD) -> int:
    return int((1 - threshold) * max(n, m) + 1e-9)


def near(a: list[str], b: list[str], threshold: float = THRESHOLD) -> bool:
    """Whether the edit similarity of two word sequences reaches the threshold."""
    return distance_within(a, b, edits_allowed(len(a), len(b), threshold)) is not None


def hashes(text: Column) -> list[Column]:
    """Two independent 64-bit hashes, which stand for a text together."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second"), text).alias("d2")]


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n, keys, odd) for rows with an id and a text; n is 0 for a text without words."""

    def run(batch: pa.RecordBatch) -> dict:
        only("near_dup")
        out = []
        for text in batch.column(3).to_pylist():
            w = word_hashes(text.split())
            out.append((len(w), bucket_keys(w), parities(w)) if len(w) else (0, None, None))
        return {
            **{c: batch.column(i) for i, c in enumerate(("doc_id", "d1", "d2"))},
            "n": pa.array([x[0] for x in out], pa.int32()),
            "keys": pa.array([x[1] for x in out], pa.list_(pa.int64())),
            "odd": pa.array([x[2] for x in out], pa.list_(pa.int64())),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes(F.col("text")), "text").filter("doc_id is not null and text is not null")
    return mapped(rows, run, "doc_id long, d1 long, d2 long, n int, keys array<bigint>, odd array<bigint>")


def _near_bags(left: Column, right: Column) -> Column:
    """Whether two rows (n, odd) can be within the distance: lengths and parities each need as many edits at least."""
    half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda a, b: a.bitwiseXOR(b))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    a, b, n, m = left["odd"], right["odd"], left["n"], right["n"]
    most = F.floor(F.greatest(n, m) * (1 - THRESHOLD) + 1e-9)
    differ = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # of texts whose lengths are that close, one has at most twice as many classes
    return F.when(F.abs(n - m) <= most, differ + F.abs(n - m) <= 2 * most).otherwise(F.lit(False))


def _texts(nodes: DataFrame, meta: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """(node, text) of the nodes."""
    needed = written(meta.select("node", "doc_id", "d1", "d2").join(nodes.distinct(), "node", "left_semi").distinct().coalesce(tasks), "needed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes(F.col("text")), "text").filter("doc_id is not null and text is not null")
    return written(rows.join(few(needed), ["doc_id", "d1", "d2"]).select("node", "text").coalesce(tasks), "texts")


def verified(pairs: DataFrame, meta: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold."""
    texts = _texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), meta, docs, tasks)

    def run(batch: pa.RecordBatch) -> dict:
        out, kept_of, kept = [], None, None
        for a, b, left, right in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != kept_of:
                kept_of, kept = b, right.split()
            if near(left.split(), kept):
                out.append((a, b))
        return {"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())}

    joined = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b").select("a", "b", "left", "right")
    out = written(mapped(joined, run, "a long, b long", rows=64).distinct().coalesce(tasks), "links")
    drop_written(texts)
    return out


class Bucket:
    """Texts of a bucket, or of two blocks of it: (node, component, n, odd, keys, text, side)."""

    def __init__(self, key: int, apart: bool):
        self.key, self.apart, self.rows, self.words = key, apart, [], {}

    def add(self, node: int, component: int, n: int, odd: list[int], keys: list[int], text: str, side: int) -> None:
        words = self.words
        self.rows.append((n, node, component, np.array(odd, np.int64), frozenset(keys), [words.setdefault(w, w) for w in text.split()], side))

    def links(self) -> list[tuple[int, int]]:
        """Links of a spanning forest of the components. Of two blocks, those between them only. Pairs that share a smaller
        key are left to its bucket."""
        rows = sorted(self.rows, key=lambda r: r[:2])
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (p := parent.get(i, i)) != i:
                parent[i] = parent.get(p, p)
                i = p
            return i

        n = np.array([r[0] for r in rows])
        most = np.array([edits_allowed(r[0], r[0]) for r in rows])
        component, side = np.array([r[2] for r in rows]), np.array([r[6] for r in rows])
        bits = np.array([len(r[3]) for r in rows])
        same = {size: (at := np.flatnonzero(bits == size), np.stack([rows[i][3] for i in at.tolist()])) for size in np.unique(bits).tolist()}
        half = {size // 2: (at, x[:, : size // 2] ^ x[:, size // 2 :]) for size, (at, x) in same.items() if size > 1}
        out = []
        for x, (own, node, own_component, odd, keys, words, own_side) in enumerate(rows):
            for at, table in (t[len(odd)] for t in (same, half) if len(odd) in t):
                # longer texts, or as long ones that come later
                begin, end = np.searchsorted(at, x + 1), np.searchsorted(n[at] - most[at], own, "right")
                if begin >= end:
                    continue
                y = at[begin:end]
                open_ = component[y] != own_component
                if self.apart:
                    open_ &= side[y] != own_side
                y, rest = y[open_], table[begin:end][open_]
                y = y[np.bitwise_count(rest ^ odd).sum(axis=1, dtype=np.int64) + n[y] - own <= 2 * most[y]]
                for k in y.tolist():
                    _, other, other_component, _, other_keys, other_words, _ = rows[k]
                    a, b = find(own_component), find(other_component)
                    if a != b and min(keys & other_keys) == self.key and near(words, other_words):
                        parent[max(a, b)] = min(a, b)
                        out.append((max(node, other), min(node, other)))
        return out


def met_in_blocks(rows: DataFrame) -> DataFrame:
    """The links (a, b) between the components of each bucket; rows: (key, node, component, n, odd, keys, text)."""
    per = rows.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"))
    dealt = rows.join(per, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "n", "odd", "keys", "text", (F.col("block") > F.col("other")).cast("int").alias("side"))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        unit, bucket = None, None

        def closed() -> pa.RecordBatch:
            found = bucket.links()
            return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        for batch in batches:
            for part in by_slices(batch):
                for key, i, j, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (key, i, j) != unit:
                        if bucket:
                            yield closed()
                        unit, bucket = (key, i, j), Bucket(key, i != j)
                    bucket.add(*row)
        if bucket:
            yield closed()

    return dealt.mapInArrow(run, "a long, b long")


def _nodes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches with a number for each different text, the texts' numbers with their smallest id). The number is the first hash;
    where different texts share it, it is another hash for all of them but one."""
    first = written(sketches.groupBy("d1").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi"), F.min("doc_id").alias("doc_id")), "copies")
    shared = written(first.filter("lo < hi").select("d1", "lo"), "shared_hashes")
    if shared.isEmpty():
        return sketches.withColumn("node", F.col("d1")), first.select(F.col("d1").alias("node"), "doc_id")
    node = F.when(F.col("d2") > F.col("lo"), F.xxhash64("d1", "d2")).otherwise(F.col("d1"))
    named = sketches.join(few(shared), "d1", "left").withColumn("node", node).drop("lo")
    return named, written(named.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "copies")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_node, d1, d2) for each row of docs with an id and a text: a node is a different text, a
    class is named by its smallest id, and the smallest node of that. d1 and d2 are the hashes of the text."""
    sketches, first = _nodes(written(sketch_table(docs), "sketches"))
    tasks = max(8, first.count() // TASK_TEXTS)
    held = lambda df, name: written(df.coalesce(tasks), name)
    meta = held(sketches.filter("n > 0").join(first, ["node", "doc_id"], "left_semi"), "sketched")
    bag = F.struct("n", "odd")
    buckets = meta.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("key", "b")
    shared = held(buckets.join(shared, "key"), "buckets")  # of two texts at least
    bags = meta.select("node", bag.alias("bag")).distinct()

    pairs = shared.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    pairs = pairs.join(bags.toDF("a", "x"), "a").join(bags.toDF("b", "y"), "b").filter(_near_bags(F.col("x"), F.col("y"))).select("a", "b")
    found = held(components(verified(held(pairs, "pairs"), meta, docs, tasks), tasks=tasks), "components")

    label = meta.select("node", "n", "odd", "keys").distinct().join(found.withColumnRenamed("id", "node"), "node", "left")
    label = label.withColumn("component", F.coalesce("component", "node"))
    open_rows = shared.select("key", "node").join(label.select("node", "component"), "node")
    mixed = open_rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    rest = held(open_rows.join(mixed, "key").select("key", "node").distinct(), "open")
    texts = _texts(rest.select("node"), meta, docs, tasks)
    more = held(met_in_blocks(rest.join(label.join(texts, "node"), "node")), "links")
    found = held(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), tasks=tasks), "components")
    drop_written(rest, texts)
    linked = found.select(F.col("id").alias("node"), "component").join(first, "node")
    named = linked.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    named = linked.join(named, "component").select("node", "least")
    per = first.join(named, "node", "left").select("node", F.coalesce("least", F.struct("doc_id", "node")).alias("least"))
    out = sketches.select("doc_id", "node", "d1", "d2", "n").join(per, "node")
    named = lambda own, least: F.when(F.col("n") > 0, F.col(f"least.{least}")).otherwise(F.col(own))
    return out.select("doc_id", "node", named("doc_id", "doc_id").alias("class_id"), named("node", "node").alias("class_node"), "d1", "d2", "n")


def _kept() -> Column:
    return (F.col("doc_id") == F.col("class_id")) & (F.col("node") == F.col("class_node"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (its own id where it is in no group), kept. Kept is the text that its
    class is named by, on all rows that repeat it under that id."""
    found = near_classes(docs).select("doc_id", "class_id", _kept().alias("kept"))
    id = F.col("doc_id").cast("long")
    rest = docs.filter(id.isNull() | F.col("text").isNull())
    return found.unionByName(rest.select(id.alias("doc_id"), id.alias("class_id"), F.lit(True).alias("kept")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one that it is named by; of rows that repeat its id and its text one stays.
    Rows without an id, and those without words, stay."""
    found = written(near_classes(docs).filter("n > 0"), "classes")
    again = written(found.filter(_kept()).groupBy("doc_id", "d1", "d2").count().filter("count > 1").select("doc_id", "d1", "d2"), "repeated")
    names = docs.columns
    rows = docs.withColumns({"_near_id": F.col("doc_id").cast("long"), **dict(zip(("_near_1", "_near_2"), hashes(F.col("text")), strict=True))})
    key = ["_near_id", "_near_1", "_near_2"]
    gone = few(written(found.filter(~_kept()).select("doc_id", "d1", "d2").distinct(), "gone").toDF(*key))
    kept = rows.join(gone, key, "left_anti")
    if again.isEmpty():
        return kept.select(*names)
    again = few(again).toDF(*key)
    once = kept.join(again, key, "left_semi").dropDuplicates(key)
    return kept.join(again, key, "left_anti").unionByName(once).select(*names)
