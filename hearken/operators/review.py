"""Review packets: queues, freezing of accepted rows, audio requests, clip windows, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.text import _col, stable_hash, two_decimals
from hearken.operators.keyed import last_of
from hearken.operators.sampling import by_status

# Audit statuses that need a listener, in order, and what a reviewer may decide.
AUDIO_STATUSES = ("potentially_harmful_semantic_shift", "low_impact_discourse_or_hedge_loss")
DECISIONS = ("harmful", "acceptable", "artifact", "unclear")


def queue(annotations: DataFrame) -> DataFrame:
    """Annotations wrapped for review: empty decision fields and the annotation as `final_annotation`."""
    blank = [F.lit("").alias(c) for c in ("reviewer_id", "review_notes", "reject_reason")]
    return annotations.select("review_id", F.lit("unreviewed").alias("review_status"), *blank, F.struct(*[c for c in annotations.columns if c != "review_id"]).alias("final_annotation"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("review_status = 'accepted' and final_annotation is not null")


def freeze(rows: DataFrame) -> DataFrame:
    """The annotations of accepted rows, valid or not."""
    return accepted(rows).select("review_id", "final_annotation.*")


def audio_requests(rows: DataFrame, *, file_key: str, archive: str, include_unreviewed: bool = False) -> DataFrame:
    keep = F.col("review_status").isin("accepted", "unreviewed") if include_unreviewed else F.col("review_status") == "accepted"
    return rows.filter(keep).withColumns({"file_key": F.lit(file_key), "archive": F.lit(archive), "request_status": F.lit("requested")})


def with_audio_path(rows: DataFrame, path: Column) -> DataFrame:
    """Sets final_annotation.audio_path and the presence flag."""
    return rows.withColumn("final_annotation", F.col("final_annotation").withField("audio_path", path)).withColumn("audio_present", F.coalesce(path != "", F.lit(False)))


def clip_window(start: Column | str, end: Column | str, frames: Column | str, rate: int = 16000, padding: float = 0.25) -> Column:
    """struct<first, last, seconds> of a padded clip in frames; null where it is empty."""
    first = F.greatest(F.lit(0), ((_col(start) - padding) * rate).cast("long"))
    last = F.least(_col(frames), ((_col(end) + padding) * rate).cast("long"))
    return F.when(last > first, F.struct(first.alias("first"), last.alias("last"), ((last - first) / rate).alias("seconds")))


def packet_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("clip_duration_sec") / 60, 2).alias("minutes"))


def label_counts(manifest: DataFrame, labels: str = "critical_categories", *, once_per_row: bool = False) -> DataFrame:
    each = F.array_distinct(labels) if once_per_row else F.col(labels)
    return manifest.select(F.explode(each).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def audio_review(audit: DataFrame) -> DataFrame:
    """Audited units that need a listener, by status, then id and unit."""
    return by_status(audit, "text_audit_status", AUDIO_STATUSES, "review_id", "unit_index")


def audio_packet(audit: DataFrame, manifest: DataFrame, clips: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The packet for listeners: audited units of `audio_review` with their utterance and their clip, in order, and empty fields
    for the reviewer. A unit without a row of the manifest is an error; one without a clip has null times.

    audit: review_id, unit_index, utterance_id, cohort, category, dialect, standard, automatic_outcome, text_audit_status,
    text_audit_reason, text_audit_note, hypothesis. manifest: review_id, clip_path and both transcripts. clips: review_id, start_sec,
    end_sec, clip_duration_sec, domain, intent, critical_categories. listing has the column path, of clips that are there;
    without it clip_present says whether there is a path. Of repeated rows of manifest and clips the last counts."""
    known = last_of(manifest, "review_id").select("review_id", "clip_path", "dialect_transcript", "standard_transcript")
    cut = last_of(clips, "review_id").select("review_id", "start_sec", "end_sec", "clip_duration_sec", "domain", "intent", "critical_categories")
    units = require_match(audio_review(audit), known, "review_id").join(cut, "review_id", "left")
    if listing is None:
        units = units.withColumn("clip_present", F.coalesce(F.col("clip_path") != "", F.lit(False)))
    else:
        there = listing.select(F.col("path").alias("clip_path")).distinct().withColumn("clip_present", F.lit(True))
        units = units.join(there, "clip_path", "left").withColumn("clip_present", F.coalesce("clip_present", F.lit(False)))
    renamed = {"dialect_unit": "dialect", "standard_unit": "standard", "asr_hypothesis": "hypothesis"}
    blank = ("reviewer_decision", "reviewer_confidence", "reviewer_notes")
    names = ("review_id", "unit_index", "utterance_id", "cohort", "category", "dialect_unit", "standard_unit", "automatic_outcome", "text_audit_status", "text_audit_reason", "text_audit_note", "clip_path", "clip_present", "start_sec", "end_sec", "clip_duration_sec", "domain", "intent", "critical_categories", "dialect_transcript", "standard_transcript", "asr_hypothesis")
    out = units.withColumn("critical_categories", F.coalesce("critical_categories", F.array().cast("array<string>")))
    out = out.select(*[F.col(renamed.get(c, c)).alias(c) for c in names], *[F.lit("").alias(c) for c in blank], F.array(*map(F.lit, DECISIONS)).alias("allowed_reviewer_decisions"), F.lit("unreviewed").alias("review_status"))
    return by_status(out, "text_audit_status", AUDIO_STATUSES, "review_id", "unit_index")


def shareable_packet(packet: DataFrame) -> DataFrame:
    """What of an audio packet may be shared: metadata and a hash of the utterance, no transcript and no surface."""
    keep = ("review_id", "unit_index", "cohort", "category", "automatic_outcome", "text_audit_status", "text_audit_reason", "domain", "intent", "critical_categories", "clip_duration_sec", "clip_present", "review_status")
    return packet.select(*keep, stable_hash(F.concat_ws(":", _filled("utterance_id"), F.col("unit_index").cast("string"))).alias("utterance_hash"))


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def redact(df: DataFrame, keep: list[str], hashes: dict[str, Column]) -> DataFrame:
    """The shareable tier: listed columns and hashes, nothing else."""
    return df.select(*keep, *[stable_hash(c).alias(k) for k, c in hashes.items()])


def require_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises where a row of left has no match."""
    out = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return out.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(F.format_string("no match for %s", F.col(key).cast("string"))).cast("boolean")).otherwise(True)).filter("_there").drop("_there")


__all__ = ["accepted", "audio_packet", "audio_requests", "audio_review", "clip_window", "freeze", "label_counts", "packet_totals", "queue", "redact", "require_match", "shareable_packet", "two_decimals", "with_audio_path"]
