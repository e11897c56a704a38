"""Known results of the statistics, and hand-made rows for the other operators."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from hearken.functions import hangul, text
from hearken.operators import cohorts, mining, review, sampling, scoring, stats, validate
from hearken.sources import io

# Fixed values: (marked units, errors in them, plain units, errors in them) of fifty utterances, by cohort.
FIRST = [(1, 1, 14, 3), (1, 0, 3, 0), (1, 1, 10, 1), (1, 1, 14, 4), (1, 0, 9, 0), (2, 1, 8, 1), (1, 1, 6, 2), (1, 1, 4, 2), (2, 1, 11, 4), (2, 1, 3, 1), (1, 1, 12, 2), (2, 0, 8, 0), (1, 1, 11, 3), (1, 1, 10, 1), (4, 3, 5, 2), (1, 0, 10, 3), (1, 0, 7, 1), (1, 0, 8, 0), (1, 0, 7, 0), (1, 0, 21, 1), (1, 0, 12, 6), (2, 1, 10, 0), (2, 0, 12, 1), (1, 1, 7, 1), (1, 0, 7, 1)]
SECOND = [(1, 0, 16, 5), (1, 0, 12, 2), (3, 2, 9, 5), (1, 1, 3, 1), (1, 0, 10, 1), (1, 1, 2, 0), (1, 0, 12, 1), (1, 1, 13, 1), (2, 1, 4, 0), (1, 0, 5, 1), (1, 0, 7, 1), (1, 0, 18, 3), (2, 1, 10, 0), (2, 2, 9, 1), (1, 1, 12, 3), (2, 1, 5, 0), (1, 0, 11, 1), (1, 0, 6, 0), (1, 1, 6, 2), (1, 0, 12, 1), (1, 1, 17, 1), (2, 0, 7, 1), (1, 0, 7, 5), (1, 0, 21, 1), (1, 1, 8, 4)]


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [(f"r{i:02d}", c, *x) for i, (c, x) in enumerate([("busan", x) for x in FIRST] + [("gyeongsang_other", x) for x in SECOND])]
    return spark.createDataFrame(rows, "review_id string, cohort string, dialect_total long, dialect_error long, plain_total long, plain_error long").cache()


def test_model_metrics(spark):
    span = lambda t, c: {"span_text": t, "category": c, "business_risk": "high", "expected_asr_preservation": ""}
    slot = lambda n, v: {"name": n, "value": v, "span_text": v}
    gold = spark.createDataFrame([
        {"utterance_id": "a", "dialect_transcript": "해지 안 된다", "intent": "x", "slots": [slot("s", "해지")], "critical_spans": [span("안", "negation")]},
        {"utterance_id": "b", "dialect_transcript": "15만 원 맞나", "intent": "y", "slots": [slot("n", "15만 원")], "critical_spans": [span("15만 원", "amount"), span("맞", "confirmation")]},
    ], io.ANNOTATION)
    asr = spark.createDataFrame([
        {"utterance_id": "a", "model": "m", "hypothesis": "해지 된다", "intent_prediction": "x", "slots": [slot("s", "해지")]},
        {"utterance_id": "b", "model": "m", "hypothesis": "50만 원 맞나", "intent_prediction": "z", "slots": [slot("n", "50만 원")]},
    ], io.ASR)
    r = scoring.evaluate(gold, asr).first()
    assert [r[c] for c in ("cer", "wer", "intent_accuracy", "slot_precision", "slot_recall", "slot_f1", "critical_error_rate")] == pytest.approx([3 / 11, 2 / 6, 0.5, 0.5, 0.5, 0.5, 2 / 3])
    assert r["critical_by_category"] == {"negation": 1.0, "amount": 1.0, "confirmation": 0.0}
    with pytest.raises(Exception, match="no gold row"):
        scoring.evaluate(gold.limit(1), asr).collect()


def test_clustered_statistics(clusters):
    r = stats.rates(clusters).first()
    assert (r["clusters"], r["dialect_error"], r["dialect_total"], r["plain_error"], r["plain_total"]) == (50, 30, 66, 81, 471)
    assert [round(r[c], 6) for c in ("difference", "ratio", "odds_ratio")] == [0.282571, 2.643098, 4.012346]
    z = stats.two_proportion(clusters).first()
    assert z["z"] == pytest.approx(5.309220, abs=1e-6) and z["p"] == pytest.approx(1.10095e-07, rel=1e-5) and z["naive_se"] == pytest.approx(0.0532227, abs=1e-7)
    w = stats.wald_interval(clusters).first()
    assert (w["lower"], w["upper"]) == pytest.approx((2.337231, 6.888029), abs=1e-6)
    m = stats.mantel_haenszel(clusters).first()
    assert m["mh_odds_ratio"] == pytest.approx(4.104037483813735, rel=1e-12) and m["mh_log_se"] == pytest.approx(0.3208417449424891, rel=1e-12)
    assert (m["mh_lower"], m["mh_upper"], m["mh_z"]) == pytest.approx((2.188292, 7.696926, 4.400834), abs=1e-6)
    n = stats.permutation_null(clusters).first()
    assert (n["informative"], round(n["null_mean"], 6), round(n["null_sd"], 6)) == (44, 0.039268, 0.051365)
    by = {r["cohort"]: r["dialect_rate"] for r in stats.rates(clusters, "cohort").collect()}
    assert sorted(round(v, 6) for v in by.values()) == [0.4375, 0.470588]


def test_resampling(clusters):
    b = stats.bootstrap(clusters, draws=2000)
    r = b.first()
    assert r["difference_ci"] == pytest.approx([0.169186, 0.393531], abs=0.02) and r["difference_se"] == pytest.approx(0.057414, abs=0.004)
    d = stats.design_effect(b, stats.two_proportion(clusters)).first()["design_effect"]
    assert d == pytest.approx(1.163717, abs=0.2)
    c = stats.cohort_contrast(clusters, "busan", "gyeongsang_other", draws=300).first()
    assert c["comparable"] and c["difference_ci"][0] < c["difference"] < c["difference_ci"][1]
    units = clusters.select("review_id", F.explode(F.concat(*[F.array_repeat(F.struct(F.lit(a).alias("is_dialect"), F.lit(e).alias("is_error")), n.cast("int")) for a, e, n in ((True, True, F.col("dialect_error")), (True, False, F.col("dialect_total") - F.col("dialect_error")), (False, True, F.col("plain_error")), (False, False, F.col("plain_total") - F.col("plain_error")))])).alias("u")).select("review_id", "u.*")
    p = stats.permutation_test(units, draws=400).first()
    assert p["null_mean"] == pytest.approx(0.039268, abs=0.01) and p["null_sd"] == pytest.approx(0.051365, abs=0.008) and p["p"] < 0.01
    assert stats.bootstrap_loss(clusters.select("review_id", F.col("dialect_error").alias("hits"), F.col("dialect_total").alias("total")), draws=100).first()["loss_se"] > 0


def test_audio_review_and_packets(spark):
    one, two = review.AUDIO_STATUSES
    audit = spark.createDataFrame([("b", 2, one), ("b", 1, two), ("a", 9, one), ("c", 1, "fine"), ("a", 1, two), ("b", 1, one)], "review_id string, unit_index long, text_audit_status string")
    assert [(r["review_id"], r["unit_index"]) for r in review.audio_review(audit).collect()] == [("a", 9), ("b", 1), ("b", 2), ("a", 1), ("b", 1)]
    packet = spark.createDataFrame([(30.0, ["x", "x", "y"]), (45.5, ["y"])], "clip_duration_sec double, critical_categories array<string>")
    assert tuple(review.packet_totals(packet).first()) == (2, 1.26)
    assert {r["label"]: r["n"] for r in review.label_counts(packet).collect()} == {"x": 2, "y": 2}
    assert {r["label"]: r["n"] for r in review.label_counts(packet, once_per_row=True).collect()} == {"x": 1, "y": 2}


def test_dialogs_and_profile(spark, tmp_path):
    word = lambda i, e, s, d: {"id": i, "eojeol": e, "standard": s, "isDialect": d}
    dialog = {
        "id": "d",
        "metadata": {"topic": "food"},
        "speaker": [{"id": "p", "birthplace": "부산", "principal_residence": "부산", "current_residence": "부산"}, {"id": "q", "birthplace": "대구", "principal_residence": "대구", "current_residence": "부산"}],
        "utterance": [
            {"id": "1", "speaker_id": "p", "dialect_form": "맞나", "standard_form": "맞나요", "eojeolList": [word(1, "맞나", "맞나요", True), word(2, "네", "네", False)]},
            {"id": "2", "speaker_id": "q", "dialect_form": "그래", "standard_form": "그래", "eojeolList": [word(1, "그래", "그래", False)]},
            {"id": "3", "speaker_id": "nobody", "eojeolList": []},
        ],
    }
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.json").write_text(json.dumps(dialog, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = cohorts.utterances(io.read_json_folder(spark, str(tmp_path / "one")))
    assert sorted((r["source_file"], r["speaker_id"], r["slice_label"], r["eojeol_count"], r["dialect_count"]) for r in rows.collect()) == [("a.json", "p", "busan_strict", 2, 1), ("a.json", "q", "busan_residence", 1, 0)]
    assert {r["slice_label"]: r["eojeols"] for r in cohorts.slice_summary(rows).collect()} == {"busan_strict": 2, "busan_residence": 1}
    assert sorted(map(tuple, cohorts.topic_counts(rows).collect())) == [("busan_residence", "food", 1), ("busan_strict", "food", 1)]
    assert cohorts.topic_counts(cohorts.utterances(io.read_json_folder(spark, str(tmp_path / "one")).drop("metadata"))).count() == 0
    grains = [r.asDict() for r in cohorts.taxonomy(rows).collect()]
    assert len(grains) == 4 and all(g["n"] == 1 for g in grains) and {g["category"] for g in grains} == {None, "ending_or_particle_variant"}
    assert cohorts.review_candidates(rows).count() == 1
    assert {r["slice_label"] for r in cohorts.with_slices(rows.drop("slice_label"), rows.limit(0)).collect()} == {"other"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("labels/a.json", json.dumps(dialog, ensure_ascii=False))
        z.writestr("labels/list.json", "[1]")
    zipped = io.read_zip_json(spark, str(tmp_path))
    assert zipped.count() == 1 and zipped.first()["source_file"] == "a.json"
    raw = spark.read.text(str(tmp_path / "one/a.json"), wholetext=True)
    p = {(r["key"], r["value"]): r["n"] for r in cohorts.document_profile(raw, "value", count_keys=("dialect_form", "eojeolList"), value_keys=("current_residence",)).collect()}
    assert p == {("dialect_form", None): 2, ("eojeolList", None): 3, ("current_residence", "부산"): 2}


def test_validation(spark):
    row = {k: "x" for k in validate.REQUIRED} | {"domain": "billing", "critical_spans": [{"span_text": "a", "category": "amount", "business_risk": "high"}]}
    told = lambda **change: json.dumps({k: v for k, v in (row | change).items() if v is not None})
    faults = {
        told(): set(),
        told(slots=[{"name": "a", "value": "b"}], clarification_required=True): set(),
        told(intent=None): {"required"},
        told(speaker_sex="f"): {"additional"},
        told(critical_spans=[]): {"minItems"},
        told(critical_spans=[{"span_text": "a", "category": "amount", "business_risk": "huge"}]): {"enum"},
        told(critical_spans=[{"span_text": "a", "category": "amount", "more": 1}]): {"required", "additional"},
        told(domain=7): {"type"},
        told(slots=[{"name": 1, "value": "b"}]): {"type"},
        "[1]": {"object"},
        "{": {"json"},
    }
    df = spark.createDataFrame([(k,) for k in faults], "value string")
    for r in df.select("value", validate.violations(F.col("value")).alias("v")).collect():
        assert {x["rule"] for x in r["v"]} == faults[r["value"]], r
    assert tuple(validate.coverage(df, "value").first()[:3]) == (11, 2, 9)


def test_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.char_edits(F.lit("가 나"), F.lit("가다")), F.size(text.words(F.lit(" a　b "))), text.contains_normalized(F.lit("a b"), F.lit("!")), text.two_decimals(F.lit(1.005)),
        stats.erfc(F.lit(0.5)), stats.erfc(F.lit(3.0)), hangul.syllable(F.lit("한")), mining.intent(mining.domain(F.lit("병원 갔다"))), text.common_prefix(F.lit(""), F.lit("")),
    ).first()
    assert got[:4] == (1, 2, False, "1.00") or got[:4] == (1, 2, False, "1.01")
    assert got[4] == pytest.approx(math.erfc(0.5), rel=1e-12) and got[5] == pytest.approx(math.erfc(3.0), rel=1e-12)
    assert tuple(got[6]) == (18, 0, 4) and got[7] == "handle_billing_or_refund" and got[8] == 0


def test_round_robin(spark):
    rows = spark.createDataFrame([("c", "A", "h1"), ("c", "B", "h2"), ("c", "A", "h3")], "cohort string, speaker string, id string")
    pick = lambda n, m: [r["id"] for r in sampling.round_robin(rows, "cohort", "speaker", "id", n, m).orderBy("taken").collect()]
    assert pick(2, 2) == ["h1", "h2"] and pick(3, 2) == ["h1", "h2", "h3"] and pick(3, 1) == ["h1", "h2"]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("cell"))
    a = {r["id"] for r in sampling.stratified(rows, ["cell"], "id", 7).collect()}
    assert a == {r["id"] for r in sampling.stratified(rows.repartition(13), ["cell"], "id", 7).collect()} and len(a) == 14


def test_outcome_joins_and_sinks(spark, tmp_path):
    manifest = spark.createDataFrame([("r1", "u1"), ("r2", "u2"), ("r3", "u3")], "review_id string, utterance_id string")
    asr = spark.createDataFrame([("r1", None, "x"), (None, "u2", "y")], "review_id string, utterance_id string, hypothesis string")
    assert [r["hypothesis"] for r in scoring.with_outcomes(manifest, asr).orderBy("review_id").collect()] == ["x", "y", None]
    io.write_two_tiers(scoring.with_outcomes(manifest, asr), str(tmp_path / "local"), str(tmp_path / "shared"), ["review_id"])
    assert spark.read.json(str(tmp_path / "shared")).columns == ["review_id"]
    io.write_tsv(manifest.withColumn("a", F.array(F.lit(1))), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first()["a"] == "[1]"
    assert "null" in io.summary_json(spark.sql("SELECT double('NaN') AS x")) and "| x |" in io.markdown_table(spark.sql("SELECT 1 AS x"))


def test_review_queue(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "review_id string, audio_path string")
    q = review.queue(rows)
    assert review.freeze(q).count() == 0
    done = review.with_audio_path(q.withColumn("review_status", F.lit("accepted")), F.lit("p.wav"))
    assert {r["audio_path"] for r in review.freeze(done.drop("audio_present")).collect()} == {"p.wav"}
    assert review.audio_requests(q, file_key="k", archive="z", include_unreviewed=True).count() == 2
    with pytest.raises(Exception, match="no match"):
        review.require_match(rows, rows.limit(1), "review_id").collect()


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((16384).to_bytes(2, "little", signed=True) * 4)
    r = io.read_wav(spark, str(tmp_path)).first()
    assert (r["rate"], r["channels"], r["frames"]) == (16000, 2, 2) and r["samples"] == [0.5, 0.5]


def test_span_losses(spark):
    # Published match types of 74 labels of fifty utterances, and their loss rates.
    found = {"eojeol_initial": 41, "phantom_label": 16, "numeral_equivalent": 10, "absent": 6, "substring_only": 1}
    rows = spark.createDataFrame([("m", k) for k, n in found.items() for _ in range(n)] + [("none", "phantom_label")], "model string, match_type string")
    got = {r["model"]: r for r in scoring.span_losses(rows, ["model"]).collect()}
    assert (got["m"]["scorable"], got["m"]["strict_loss"], got["m"]["inclusive_loss"]) == (58, 0.10344827586206896, 0.1206896551724138)
    assert got["none"]["scorable"] == 0 and got["none"]["strict_loss"] is None and got["none"]["inclusive_loss"] is None


def test_marked_contrast(spark):
    rows = [(f"r{i}", "absent" if i % 2 else "eojeol_initial", True) for i in range(12)] + [(f"r{i}", "eojeol_initial", False) for i in range(20)] + [("r0", "phantom_label", True)]
    schema = "review_id string, match_type string, dialect_marked boolean"
    r = stats.marked_contrast(spark.createDataFrame(rows, schema), draws=200).first()
    assert (r["marked_clusters"], r["marked_spans"], r["plain_spans"], r["difference"], r["comparable"], r["underpowered"], r["crosses_zero"]) == (12, 12, 20, 0.5, True, False, False)
    assert 0 < r["difference_ci"][0] < 0.5 < r["difference_ci"][1] < 1
    r = stats.marked_contrast(spark.createDataFrame(rows[:4], schema), draws=50).first()
    assert (r["comparable"], r["underpowered"], r["plain_loss"], r["difference"]) == (False, True, None, None)


def test_clips_and_listing(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 16000, 0, "NONE", ""))
        w.writeframes(bytes(range(64)) * 1000)  # 16000 frames
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.wav")).select("content")
    r = io.cut_clips(files.withColumns({"review_id": F.lit("x"), "start_sec": F.lit(0.5), "end_sec": F.lit(0.9)})).first()
    assert r["review_id"] == "x" and r["seconds"] == 0.75
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips/x.wav").write_bytes(bytes(r["clip"]))
    again = io.read_wav(spark, str(tmp_path / "clips")).first()
    assert (again["rate"], again["channels"], again["frames"]) == (16000, 2, 12000)
    assert again["samples"] == io.read_wav(spark, str(tmp_path / "a.wav")).first()["samples"][4000:]
    with pytest.raises(Exception, match="is empty"):
        io.cut_clips(files.withColumns({"review_id": F.lit("x"), "start_sec": F.lit(2.0), "end_sec": F.lit(3.0)})).collect()
    (tmp_path / "zips").mkdir()
    with pytest.raises(ValueError, match="exactly one"):
        io.audio_listing(spark, str(tmp_path / "zips"))
    with zipfile.ZipFile(tmp_path / "zips/a.zip", "w") as z:
        z.writestr("in/s1.wav", b"x")
        z.writestr("s2.wav", b"y")
        z.writestr("note.txt", b"z")
    assert [tuple(r)[:2] for r in io.audio_listing(spark, str(tmp_path / "zips")).collect()] == [("s1", "in/s1.wav"), ("s2", "s2.wav")]


def test_stream(spark, tmp_path):
    from hearken.streaming.ingest import stream_outcomes

    unit = "array<struct<dialect:string,standard:string>>"
    manifest = spark.createDataFrame([("r1", "busan", [("aa", "ab")], [("cc", "cc")])], f"review_id string, cohort string, dialect_units {unit}, plain_units {unit}")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"review_id":"r1","model":"m","hypothesis":"zz cc"}\n')
    q = stream_outcomes(spark, str(tmp_path / "in"), manifest).writeStream.outputMode("complete").format("memory").queryName("taken_in").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM taken_in").first()
    assert (r["model"], r["dialect_error"], r["plain_error"], r["clusters"]) == ("m", 1, 0, 1)
