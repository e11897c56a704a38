"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, S[i] is the sum of (c[j] + 1) * B ** j over j < i, modulo a prime; (S[j] - S[i]) * B ** -i
is the hash of the span [i, j), whatever its place. Two primes make collisions unlikely. Any two spans are compared in
constant time, and the longest common extension of two places is found by binary search.

The fingerprint has the hash of the whole text, its length, and the KEEP smallest mixed hashes of its spans of SPAN code
points (a text shorter than that is one span), each once. The likeness of two fingerprints estimates the Jaccard
similarity of their sets of spans from the KEEP smallest of the union; 1.0 for two empty texts, 0.0 for one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import by_slices, id_bucket, id_splits, literal_array

PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 69069069)
SPAN, KEEP = 16, 64
#: Powers that a worker keeps, 32 bytes each.
KEPT_POWERS = 1 << 20

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, B ** j and B ** -j for j up to n at least; kept and doubled, but for very long texts."""
    if not _powers or len(_powers[0][0]) <= n:
        size = 1 << max(12, n.bit_length())
        made = []
        for p, b in zip(PRIMES, BASES, strict=True):
            two = []
            for base in (b, pow(b, -1, p)):
                out = np.ones(1, np.uint64)
                while len(out) < size + 1:
                    out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
                two.append(out)
            made.append(tuple(two))
        if size > KEPT_POWERS:
            return made
        _powers[:] = made
    return _powers


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        c = self.codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for p, (up, _) in zip(PRIMES, powers(n), strict=True):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(c * up[:n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def __len__(self) -> int:
        return len(self.codes)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of [i, j)."""
        return tuple(int((int(s[j]) - int(s[i])) % p * int(down[i]) % p) for s, p, (_, down) in zip(self.sums, PRIMES, powers(len(self)), strict=True))

    def grams(self, k: int) -> np.ndarray:
        """One 64-bit hash for each span of k code points; of the whole text if it is shorter."""
        n = len(self)
        k = min(k, n)
        m = n - k + 1
        two = []
        for s, p, (_, down) in zip(self.sums, PRIMES, powers(n), strict=True):
            q = np.uint64(p)
            two.append((s[k:] + q - s[:m]) % q * down[:m] % q)
        return two[0] << np.uint64(32) ^ two[1]

    def common_extension(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """How many code points agree from place i here and place j there."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFF)


def smallest(hashes: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The keep smallest distinct values, sorted."""
    size = keep
    while size * 4 < len(hashes):
        size *= 4
        out = np.unique(np.partition(hashes, size - 1)[:size])
        if len(out) >= keep:
            return out[:keep]
    return np.unique(hashes)[:keep]


def fingerprint_of(hashed: PrefixHash) -> tuple[str, np.ndarray]:
    if not len(hashed):
        return "0-", np.zeros(0, np.uint64)
    kept = smallest(_mix(hashed.grams(SPAN)))
    whole = hashed.span(0, len(hashed))
    return f"{len(hashed):x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{x:010x}" for x in kept.tolist()), kept


def parsed(fingerprint: str) -> np.ndarray:
    """The kept hashes of a fingerprint."""
    tail = fingerprint.rpartition("-")[2]
    return np.array([int(tail[i : i + 10], 16) for i in range(0, len(tail), 10)], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEEP]
    return float(np.isin(union, a, assume_unique=True).astype(int) @ np.isin(union, b, assume_unique=True).astype(int) / len(union))


def edited_text(text: str, following: str) -> str:
    """The last quarter (floor) of the code points replaced by as many of the following text's first, or all of them."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    lce_edited, the longest common extension of the text and its edited text from their starts.

    The next document is that of the next doc_id in ascending order (nulls first, ties by text), after the last the first. Null
    texts count as empty. Documents go to ranges of ids; the first of a range also goes to the range before it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    splits = id_splits(docs, "doc_id")
    bucket = id_bucket(F.col("doc_id"), splits, kind)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), bucket.alias("bucket"))
    # the first id of each range: as many rows as there are ranges, which id_splits bounds; a null id comes first of all
    heads = {r["bucket"]: (r["id"], r["nulls"] > 0) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    every = range(max(order, default=-1) + 1)
    first = F.get(literal_array([None if b not in heads or heads[b][1] else heads[b][0] for b in every], kind), F.col("bucket"))
    nulls_first = F.get(literal_array([b in heads and heads[b][1] for b in every], "boolean"), F.col("bucket"))
    leads = F.coalesce(F.when(F.col("doc_id").isNull(), nulls_first).otherwise(F.col("doc_id") == first), F.lit(False))
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("tail"))
    also = F.struct(F.get(literal_array([before.get(b) for b in every], "int"), F.col("bucket")).alias("to"), F.lit(1).alias("tail"))
    goes = F.when(leads, F.array(own, also)).otherwise(F.array(own))
    dealt = rows.withColumn("go", F.explode(goes)).select(F.col("go.to").alias("bucket"), F.col("go.tail").alias("tail"), "doc_id", "text")
    dealt = dealt.repartition(max(1, len(order)), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        last = None  # (bucket, doc_id, text, prefix arrays, fingerprint, kept)
        done = None  # the bucket that is complete

        def pair(now):
            _, doc_id, text, hashed, name, kept = last
            edited = edited_text(text, now[2])
            other = PrefixHash(edited)
            changed, changed_kept = fingerprint_of(other)
            return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name, changed, likeness(kept, changed_kept), likeness(kept, now[5]), hashed.common_extension(other))

        for batch in batches:
            for part in by_slices(batch):
                out = []
                for to, tail, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if to == done:
                        continue  # a further row that shares the id of the next range's first
                    hashed = PrefixHash(text)
                    now = (to, doc_id, text, hashed, *fingerprint_of(hashed))
                    if last is not None:
                        out.append(pair(now))
                    last = now
                    if tail:
                        last, done = None, to
                columns = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lce_edited"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited long")
