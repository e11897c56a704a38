"""Readers and writers: JSON lines (plain or gzip), JSON documents in folders and zip archives, WAV, TSV, two-tier output."""

from __future__ import annotations

import io as _io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EOJEOL = "struct<id:bigint,eojeol:string,standard:string,isDialect:boolean>"
DIALOG = (
    "id string, speaker array<struct<id:string,age:string,occupation:string,sex:string,birthplace:string,principal_residence:string,current_residence:string,education:string>>, "
    f"relation string, metadata struct<topic:string>, utterance array<struct<id:string,form:string,standard_form:string,dialect_form:string,speaker_id:string,start:double,end:double,note:string,eojeolList:array<{EOJEOL}>>>"
)
SLOT = "struct<name:string,value:string,span_text:string>"
CRITICAL = "struct<span_text:string,category:string,business_risk:string,expected_asr_preservation:string>"
ANNOTATION = (
    "utterance_id string, audio_path string, speaker_region string, speaker_age_band string, acoustic_condition string, dialect_transcript string, standard_transcript string, "
    f"domain string, intent string, slots array<{SLOT}>, critical_spans array<{CRITICAL}>, clarification_required boolean, notes string"
)
ASR = f"utterance_id string, model string, hypothesis string, intent_prediction string, slots array<{SLOT}>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType | None = None, *, strict: bool = False) -> DataFrame:
    """JSON lines, gzip by suffix. Blank lines are skipped; lines that are no object are dropped, or fail if strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `_line`, struct<file, at>, by which `operators.keyed.last_of` finds the last of repeated rows. Lines that
    are no object are dropped. A file is one task's work: for annotations and manifests, not for corpora."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    rows = files.filter(F.json_object_keys("line").isNotNull()).select(F.from_json("line", schema).alias("d"), F.struct("file", "at").alias("_line"))
    return rows.select("d.*", "_line")


def read_json_folder(spark: SparkSession, path: str, schema: str | StructType = DIALOG) -> DataFrame:
    """One document for each *.json below a folder, with its file name as source_file."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, content) of the members with a suffix, of all *.zip below a folder. Spark reads the archives, so any
    store serves; an archive is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(_io.BytesIO(content)) as z:
                    for member in sorted(x for x in z.namelist() if x.endswith(suffix)):
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "member": pa.array([member]), "content": pa.array([z.read(member)], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def read_zip_json(spark: SparkSession, path: str, schema: str = DIALOG) -> DataFrame:
    """Documents of zip members; those that are no JSON object are dropped."""
    rows = zip_members(spark, path).select(F.substring_index("member", "/", -1).alias("source_file"), F.from_json(F.decode("content", "UTF-8"), schema).alias("d"), F.decode("content", "UTF-8").alias("t"))
    return rows.filter(F.json_object_keys("t").isNotNull()).select("source_file", "d.*")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, frames, samples) of 16-bit PCM files; samples are means over channels from -1 to 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)

    def run(batches):
        import wave

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with wave.open(_io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{name} is not 16-bit PCM")
                    raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "rate": pa.array([w.getframerate()], pa.int32()), "channels": pa.array([w.getnchannels()], pa.int32()), "frames": pa.array([len(raw)], pa.int64()), "samples": pa.array([(raw.mean(axis=1) / 32768).astype(np.float32)], pa.list_(pa.float32()))})

    return files.select("path", "content").mapInArrow(run, "path string, rate int, channels int, frames long, samples array<float>")


class _Stored(_io.RawIOBase):
    """A file in any store that Spark reads, for the few bytes at its end that list a zip archive's members."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._size, self._at = store.getFileStatus(where).getLen(), 0
        self._stream, self._bytes = store.open(where), jvm.org.apache.commons.io.IOUtils.toByteArray

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = (0, self._at, self._size)[whence] + offset
        return self._at

    def read(self, n: int = -1) -> bytes:
        n = self._size - self._at if n is None or n < 0 else min(n, self._size - self._at)
        if n <= 0:
            return b""
        self._stream.seek(self._at)
        self._at += n
        return bytes(self._bytes(self._stream, n))

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def audio_listing(spark: SparkSession, path: str) -> DataFrame:
    """(stem, member, archive) of the WAV members of the one zip archive below a folder; several or none raise an error.

    Only the archive's directory is read, whatever its size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} must hold exactly one zip archive")
    archive = found[0]["path"]
    with _Stored(spark, archive) as stored, zipfile.ZipFile(stored) as z:
        members = sorted(x for x in z.namelist() if x.endswith(".wav"))
    return spark.createDataFrame([(m.rsplit("/", 1)[-1][: -len(".wav")], m, archive) for m in members], "stem string, member string, archive string")


def cut_clips(requests: DataFrame, *, padding: float = 0.25) -> DataFrame:
    """(review_id, clip, seconds) of requests (review_id, content: a WAV file, start_sec, end_sec): the padded part as a WAV
    file of the same rate, width and channels. An empty part raises an error. Each row is cut where it lies."""

    def run(batches):
        import wave

        import pyarrow as pa

        for batch in batches:
            for key, content, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with wave.open(_io.BytesIO(content)) as w:
                    rate = w.getframerate()
                    first, last = max(0, int((begin - padding) * rate)), min(w.getnframes(), int((end + padding) * rate))
                    if last <= first:
                        raise ValueError(f"the clip of {key} is empty")
                    w.setpos(first)
                    params, frames = w.getparams(), w.readframes(last - first)
                out = _io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setparams(params)
                    w.writeframes(frames)
                yield pa.RecordBatch.from_pydict({"review_id": pa.array([key], pa.string()), "clip": pa.array([out.getvalue()], pa.binary()), "seconds": pa.array([(last - first) / rate], pa.float64())})

    rows = requests.select(F.col("review_id").cast("string"), "content", F.col("start_sec").cast("double"), F.col("end_sec").cast("double"))
    return rows.mapInArrow(run, "review_id string, clip binary, seconds double")


def write_jsonl(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nested columns as compact JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(t, str) and t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("sep", "\t").option("header", True).csv(path)


def write_two_tiers(df: DataFrame, local: str, shared: str, keep: list[str]) -> None:
    """All columns to the local folder, the listed ones to the shared folder."""
    write_jsonl(df, local)
    write_jsonl(df.select(*keep), shared)


def summary_json(row: DataFrame) -> str:
    """A one-row report as indented JSON; numbers that are not finite become null."""

    def plain(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(row.first().asDict(True)), ensure_ascii=False, indent=2)


def markdown_table(rows: DataFrame, *, most: int = 1000) -> str:
    """A small report as a Markdown table; larger ones are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("the report is too large")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got)])
