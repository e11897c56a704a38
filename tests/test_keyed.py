"""The last of repeated rows, rows in order, slots in span grading, the packet for listeners."""

import pytest
from pyspark.sql import functions as F

from hearken.operators import keyed, review
from hearken.plans import workflows
from hearken.sources import io


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"k": "x", "v": 3}\n\n{"k": "x", "v": 4}\nnot json\n{"k": "y", "v": 5}\n')
    (tmp_path / "a.jsonl").write_text('{"k": "x", "v": 9}\n{"k": "z", "v": 1}\n{"k": null, "v": 2}\n')
    rows = io.read_jsonl_numbered(spark, str(tmp_path), "k string, v long")
    got = keyed.last_of(rows.repartition(5), "k")
    assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == [("x", 4), ("y", 5), ("z", 1)]
    assert sorted(map(tuple, keyed.last_of(rows.drop("_line"), "k").collect())) == [("x", 9), ("y", 5), ("z", 1)]
    assert keyed.last_of(rows.limit(0), "k").count() == 0 and keyed.last_of(rows.select("k"), "k").count() == 3


def test_rows_in_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    pick = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, rank int")
    assert [r["v"] for r in keyed.in_order(rows, pick([3, 1]), "id", "rank").collect()] == ["c", "a"]
    with pytest.raises(Exception, match="no row for 7"):
        keyed.in_order(rows, pick([3, 7]), "id", "rank").collect()


def test_slots_are_graded(spark):
    span, slot = "struct<span_text:string,category:string,business_risk:string>", "struct<name:string,value:string,span_text:string>"
    annotations = spark.createDataFrame(
        [("u1", "해지 요금 안내", "", [("해지", "intent_cue", "high"), ("", "x", "y")], [("fee", "요금", ""), ("gone", "안내", None), ("none", "", "")]), ("u2", "네", "", [("네", "confirmation", "high")], None), ("u3", "네", "", [("네", "confirmation", "high")], [])],
        f"utterance_id string, dialect_transcript string, standard_transcript string, critical_spans array<{span}>, slots array<{slot}>",
    )
    manifest = spark.createDataFrame([("u1", "r1", "c", [("요금제",)]), ("u2", "r2", "c", None)], "utterance_id string, review_id string, cohort string, dialect_units array<struct<dialect:string>>")
    asr = spark.createDataFrame([("r1", "해지 요금"), ("r9", "x")], "review_id string, hypothesis string")
    got = sorted(tuple(r)[3:] for r in workflows.span_outcomes(annotations, manifest, asr).collect())
    assert got == [("안내", "gone", "unspecified", "slot", False, "absent"), ("요금", "fee", "unspecified", "slot", True, "eojeol_initial"), ("해지", "intent_cue", "high", "critical_span", False, "eojeol_initial")]
    assert tuple(workflows.skipped_annotations(annotations, manifest, asr).first()) == (3, 2)


def test_audio_packet(spark):
    rows = [("r2", 1, "low_impact_discourse_or_hedge_loss"), ("r1", 2, "potentially_harmful_semantic_shift"), ("r1", 1, "low_impact_discourse_or_hedge_loss"), ("r3", 1, "acceptable")]
    audit = spark.createDataFrame(rows, "review_id string, unit_index long, text_audit_status string")
    for c in ("utterance_id", "cohort", "category", "dialect", "standard", "automatic_outcome", "text_audit_reason", "text_audit_note", "hypothesis"):
        audit = audit.withColumn(c, F.concat(F.lit(f"{c}-"), "review_id"))
    manifest = spark.createDataFrame([("r1", "/a.wav", "d", "s"), ("r2", "", "d", "s")], "review_id string, clip_path string, dialect_transcript string, standard_transcript string")
    clips = spark.createDataFrame([("r1", 1.0, 2.0, 1.0, "billing", "ask", ["amount"])], "review_id string, start_sec double, end_sec double, clip_duration_sec double, domain string, intent string, critical_categories array<string>")
    got = review.audio_packet(audit, manifest, clips).collect()
    assert [(r["review_id"], r["unit_index"], r["clip_present"], r["start_sec"], r["critical_categories"], r["dialect_unit"]) for r in got] == [("r1", 2, True, 1.0, ["amount"], "dialect-r1"), ("r1", 1, True, 1.0, ["amount"], "dialect-r1"), ("r2", 1, False, None, [], "dialect-r2")]
    listed = review.audio_packet(audit, manifest, clips, spark.createDataFrame([("/b.wav",)], "path string"))
    assert not any(r["clip_present"] for r in listed.collect())
    shared = review.shareable_packet(listed)
    assert not {"dialect_transcript", "dialect_unit", "utterance_id", "asr_hypothesis"} & set(shared.columns) and shared.select("utterance_hash").distinct().count() == 3
    with pytest.raises(Exception, match="no match for r2"):
        review.audio_packet(audit, manifest.filter("review_id = 'r1'"), clips).collect()
