"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained by follow-the-regularised-leader with elastic-net penalties and calibrated by a temperature.
Hashed 1- to 3-grams of the lowered text are counted over the whole text; counts times inverse document
frequencies, scaled to length 1, are the features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import by_slices, fold, mapped, sampled

BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
_PIECE = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of a whole text, in pieces of bounded memory."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(SIZE, np.int64)
    shift = np.uint32(32 - BITS)
    for at in range(0, len(codes), _PIECE):
        part = codes[at : at + _PIECE + 2] * np.uint32(0x9E3779B1)
        one = part[:_PIECE]
        hashes = [(one ^ (one >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift]
        two = (part[:-1] * np.uint32(31) + part[1:])[:_PIECE]
        hashes.append(two * np.uint32(0x85EBCA6B) >> shift)
        three = (part[:-2] * np.uint32(961) + part[1:-1] * np.uint32(31) + part[2:])[:_PIECE]
        hashes.append(three * np.uint32(0xC2B2AE35) >> shift)
        out += np.bincount(np.concatenate(hashes), minlength=SIZE)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def scores(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[index]
        return (x / np.sqrt(x @ x)) @ self.weights[index]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text)
        index = np.flatnonzero(counts)
        p = softmax(self.scores(index, counts[index]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> np.ndarray:
    """Weights (SIZE, classes) of per-coordinate FTRL over (index, values, class), in the order given."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def lazily(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for index, x, y in rows:
            zi, ni = z[index], n[index]
            w = lazily(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[index] = more
    return lazily(z, n)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not trained on."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of docs (text) that have a letter, and of those with each hashed n-gram. Every task sums its rows; the
    driver gets SIZE sums."""

    def run(batches):
        n, df = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for part in by_slices(batch):
                for text in part.column(0).to_pylist():
                    if has_letter(text):
                        n += 1
                        df += ngram_counts(text) > 0
        if n:
            index = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(index, SIZE)), pa.array(np.append(df[index], n))], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE + 1)
    for r in rows:
        out[r["gram"]] = r["n"]
    return int(out[SIZE]), out[:SIZE]


def fit_language_model(docs: DataFrame, learn_from: Column, *, sample_rows: int = 2400, least_rows: int = 20) -> LanguageModel:
    """Fits on about sample_rows labelled rows in all, equally many of each language (all of a rare one). Of more languages than
    have least_rows each of them, the most frequent are learned and the others never predicted.

    sample_rows bounds what the driver gets of rows: hashed counts of as many. The document frequencies are those of all rows
    that may be learned from. Every fifth sampled row is kept for the temperature.
    """
    rows = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, sample_rows // least_rows))
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return LanguageModel([], np.ones(SIZE), np.zeros((SIZE, 0)), 1.0)
    languages = sorted(sizes)
    each = sample_rows // len(languages)
    rate = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))]), F.col("lang"))

    def features(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(2).to_pylist():
            counts = ngram_counts(text) if has_letter(text) else np.zeros(SIZE, np.int64)
            index = np.flatnonzero(counts)
            out.append((index.astype("<u4").tobytes(), counts[index].astype("<u4").tobytes()))
        return {"h": batch.column(0), "lang": batch.column(1), "index": pa.array([x[0] for x in out], pa.binary()), "counts": pa.array([x[1] for x in out], pa.binary())}

    taken = rows.filter(F.col("lang").isin(languages)).filter(sampled(F.col("doc_id"), rate, "language"))
    taken = mapped(taken.select(F.xxhash64("doc_id", F.lit("order")).alias("h"), "lang", "text"), features, "h long, lang string, index binary, counts binary")
    got = sorted((r["h"], r["lang"], bytes(r["index"]), bytes(r["counts"])) for r in taken.collect() if r["index"])
    got = [(h, lang, np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(float)) for h, lang, i, c in got]
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    place = {k: i for i, k in enumerate(languages)}
    trained, kept = [], []
    for h, lang, index, counts in got:
        x = counts * idf[index]
        (kept if h % 5 == 0 else trained).append((index, x / np.sqrt(x @ x), place[lang]))
    weights = train_ftrl(trained, len(languages))
    model = LanguageModel(languages, idf, weights, 1.0)
    model.temperature = fit_temperature(np.array([x @ weights[i] for i, x, _ in kept]).reshape(len(kept), len(languages)), np.array([y for _, _, y in kept], int))
    return model


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter gives und and 0.0; so does every text of a
    model that no labelled row was there for. Columns of docs with those names are replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # languages x 2^15 weights: bounded by the number of languages
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index("text")

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.select(*names).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows of crc32(doc_id) mod 4 = 2, and those without an id,
    are never learned from."""
    part = fold(F.col("doc_id"), 4)
    model = fit_language_model(docs.select("doc_id", "text", "lang"), part != 2)
    scored = predict_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, *, least: float = 0.5) -> DataFrame:
    """Drops documents without a letter and those whose language is uncertain (score under least)."""
    model = fit_language_model(docs.select("doc_id", "text", "lang"), F.col("doc_id").isNotNull())
    keep = F.lit(True) if not model.languages else F.col("score") >= least
    return predict_language(docs, model).filter((F.col("lang_pred") != UNKNOWN) & keep).select(*docs.columns) if model.languages else docs.filter(F.col("text").rlike(r"\p{L}"))
