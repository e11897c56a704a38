"""Compression classifier: zstandard dictionaries of good and bad labelled text.

A text is compressed once with either dictionary; the difference of the sizes over their sum, with the share of
its bytes that compression leaves, its log length and products of these, goes through a logistic calibration that is fitted on labelled rows which
neither dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import fold, mapped, sampled

LEVEL = 3
PIECE = 4096


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False))
        return made[0], made[1]


def features(sizes: np.ndarray) -> np.ndarray:
    """From (bytes, size with the good dictionary, size with the bad one) for each text."""
    raw, good, bad = sizes.T.astype(float)
    difference = (bad - good) / (bad + good)
    left = np.log((good + bad + 2) / (2 * raw + 64))
    length = np.log1p(raw) / 8
    one = np.ones_like(raw)
    d = np.clip(difference * 10, -5, 5)
    return np.stack([one, d, d * np.abs(d), left, left * left, length, length * left, length * d], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def pieces(text: str) -> list[bytes]:
    """A text, all of it, in pieces for a dictionary."""
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A trained dictionary, or the samples themselves as its content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"        "


def compressed_sizes(texts: list[str | None], two) -> np.ndarray:
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        out[i] = len(raw), len(two[0].compress(raw)), len(two[1].compress(raw))
    return out


def fit_quality_model(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 1600, fit_rows: int = 2400) -> QualityModel | None:
    """Fits on about sample_rows labelled rows for the dictionaries and fit_rows others for the calibration, half of
    them of each label. Both bound the rows that are sent to the driver and back; the texts of the sample_rows come whole, so
    that their bytes have no bound but the length of the texts. None where a label has no row."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("q"))
    sizes = {r["q"]: r["n"] for r in marks.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    all_rows = sample_rows + fit_rows
    rate = F.when(F.col("q") == 1, min(1.0, all_rows / 2 / sizes[1])).otherwise(min(1.0, all_rows / 2 / sizes[0]))
    marks = marks.filter(sampled(F.col("doc_id"), rate, "quality")).groupBy("doc_id").agg(F.min("q").alias("q"))
    marks = marks.withColumn("for_dictionary", F.pmod(F.xxhash64("doc_id", F.lit("use")), F.lit(all_rows)) < sample_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(marks), "doc_id")  # all_rows ids at most

    def cut(batch: pa.RecordBatch) -> dict:
        return {"q": batch.column(0), "h": batch.column(1), "pieces": pa.array([pieces(x) for x in batch.column(2).to_pylist()], pa.list_(pa.binary()))}

    got = mapped(rows.filter("for_dictionary").select("q", F.xxhash64("doc_id").alias("h"), "text"), cut, "q int, h long, pieces array<binary>").collect()
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["h"], r["q"])):
        samples[r["q"]] += [bytes(x) for x in r["pieces"]]
    model = QualityModel(train_dictionary(samples[1]), train_dictionary(samples[0]), np.zeros(8))

    def measure(batch: pa.RecordBatch) -> dict:
        sizes = compressed_sizes(batch.column(2).to_pylist(), model.compressors())
        return {"q": batch.column(0), "h": batch.column(1), **{k: pa.array(sizes[:, i], pa.float64()) for i, k in enumerate(("raw", "good", "bad"))}}

    fit = mapped(rows.filter("not for_dictionary").select("q", F.xxhash64("doc_id").alias("h"), "text"), measure, "q int, h long, raw double, good double, bad double").collect()
    fit = sorted(tuple(r) for r in fit)
    if not fit:
        return None
    table = np.array(fit, float)
    y, counts = table[:, 0], np.bincount(table[:, 0].astype(int), minlength=2)
    model.weights = fit_logistic(features(table[:, 2:]), y) if counts.all() else np.array([np.sign(y[0] - 0.5) * 2.0] + [0.0] * 7)
    return model


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score) for every row of docs; null and empty texts are scored as empty ones. Without a model the score
    is 0.5."""

    def score(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        if model is None:
            values = np.full(len(texts), 0.5)
        else:
            values = 1 / (1 + np.exp(-np.clip(features(compressed_sizes(texts, two())) @ model.weights, -30, 30)))
        return {"doc_id": batch.column(0), "score": pa.array(values, pa.float64())}

    made: list = []

    def two():
        if not made:
            made.extend(model.compressors())
        return made

    return mapped(docs.select("doc_id", "text"), score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted). Labels of rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    part = fold(F.col("doc_id"), 3)
    model = fit_quality_model(docs, labels.filter(part != 1))
    return score_quality(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
