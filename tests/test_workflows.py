"""Whole analyses over hand-made rows."""

import pytest

from hearken.functions.text import cleaned_tokens
from hearken.operators import scoring
from hearken.plans import workflows

EOJEOLS = "array<struct<eojeol:string,standard:string,isDialect:boolean>>"
MANIFEST = "review_id string, utterance_id string, cohort string, dialect_units array<struct<category:string,dialect:string,standard:string>>, plain_units array<struct<standard:string>>"


@pytest.fixture(scope="module")
def measured(spark):
    manifest = spark.createDataFrame(
        [
            ("r1", "u1", "busan", [("lexical_replacement", "캤나", "했나"), ("vowel_shift", "바까도", "바꿔도"), ("vowel_shift", "", "")], [("해지",), ("오늘",)]),
            ("r2", "u2", "gyeongsang_other", [("coda_shift", "간", "각")], []),
            ("r3", "u3", "other", [("coda_shift", "간", "각")], [("해지",)]),
            ("r4", "u4", "busan", [], [("해지",)]),
        ],
        MANIFEST,
    )
    asr = spark.createDataFrame([("r1", None, "해지 캤 나 바꿔도"), (None, "u2", "아무"), ("r3", "u3", "간 해지")], "review_id string, utterance_id string, hypothesis string")
    return manifest, asr


def test_outcomes_and_rates(measured):
    outcomes = workflows.unit_outcomes(*measured)
    got = {(r["review_id"], r["category"], r["outcome"]): r["n"] for r in outcomes.collect()}
    assert got == {
        ("r1", "lexical_replacement", "surface_preserved"): 1, ("r1", "vowel_shift", "standard_normalized"): 1, ("r1", "vowel_shift", "missing_or_substituted"): 1,
        ("r1", "plain", "preserved"): 1, ("r1", "plain", "plain_error"): 1, ("r2", "coda_shift", "missing_or_substituted"): 1,
        ("r3", "coda_shift", "surface_preserved"): 1, ("r3", "plain", "preserved"): 1,
    }
    counts = {(r["cohort"], r["category"], r["outcome"]): r["n"] for r in workflows.outcome_counts(outcomes).collect()}
    assert counts[(None, None, "missing_or_substituted")] == 2 and counts[("busan", None, "plain_error")] == 1 and counts[(None, "coda_shift", "surface_preserved")] == 1
    r = workflows.probe_rates(*measured).first()
    assert (r["evaluated_utterances"], r["missing_asr_outputs"]) == (2, 1)
    assert [r[c] for c in ("dialect_unit_error_rate", "dialect_surface_change_rate", "plain_unit_error_rate")] == pytest.approx([2 / 4, 3 / 4, 1 / 2])
    nothing = workflows.probe_rates(measured[0].limit(0), measured[1]).first()
    assert nothing["evaluated_utterances"] == 0 and nothing["dialect_unit_error_rate"] == 0.0


def test_clusters_agree_with_outcomes(measured):
    by = {}
    for r in workflows.unit_outcomes(*measured).collect():
        at = by.setdefault(r["review_id"], [0, 0, 0, 0])
        plain = r["category"] == "plain"
        at[2 * plain] += r["n"]
        at[2 * plain + 1] += r["n"] * (r["outcome"] in ("missing_or_substituted", "plain_error"))
    got = {r["review_id"]: [r["dialect_total"], r["dialect_error"], r["plain_total"], r["plain_error"]] for r in scoring.clusters(scoring.with_outcomes(*measured)).collect()}
    assert got == by


def test_annotations(spark, measured):
    names = "utterance_id string, audio_path string, speaker_region string, speaker_age_band string, acoustic_condition string, dialect_transcript string, standard_transcript string, candidate_spans array<struct<span_text:string,category:string>>"
    rows = spark.createDataFrame([("u1", "", "부산", "20", "", "해지 안 된다 캤나?", None, [("캤나", "other"), ("해지", "intent_cue")]), ("u2", "", "", "", "", "가가", "가가", None), ("u3", "", "", "", "", "비슷해지면", "", None)], names)
    got = {r["utterance_id"]: r for r in workflows.preannotate(rows).collect()}
    assert set(got) == {"u1", "u3"}
    r = got["u1"]
    assert [(s["span_text"], s["category"]) for s in r["critical_spans"]] == [("해지", "intent_cue"), ("안", "negation")]
    assert r["domain"] == "cancellation" and r["intent"] == "handle_cancellation" and [s["name"] for s in r["slots"]] == ["intent_cue"]
    assert r["clarification_required"] and r["notes"].startswith("weak_preannotation_id=")
    weak = workflows.preannotate(rows)
    assert tuple(workflows.phantom_rates(weak).first()) == (3, 1, pytest.approx(1 / 3))
    again = workflows.remine(weak)
    assert tuple(workflows.phantom_rates(again).first()) == (2, 0, 0.0) and tuple(workflows.phantom_rates(again, "old_spans").first())[:2] == (3, 1)
    assert {r["utterance_id"]: len(r["critical_spans"]) for r in again.collect()} == {"u1": 2, "u3": 0}
    assert all(r["notes"].endswith(f"; {workflows.REMINED}") for r in again.collect())
    spans = {(r["utterance_id"], r["span_text"]): r["match_type"] for r in workflows.span_outcomes(weak, *measured).collect()}
    assert spans == {("u1", "해지"): "eojeol_initial", ("u1", "안"): "absent", ("u3", "해지"): "phantom_label"}


def test_choices(spark):
    unit = lambda d: [("가", "나", d), ("다", "다", False)]
    rows = spark.createDataFrame(
        [(f"r{i:02d}", "busan_strict" if i % 2 else "gyeongsang_other", unit(i != 3), ["amount", "negation", "negation"] if i % 3 else [], [("안", "negation")] if i % 4 else []) for i in range(24)] + [("x", "other", unit(True), [], [("안", "negation")])],
        f"review_id string, slice_label string, eojeols {EOJEOLS}, hints array<string>, critical_spans array<struct<span_text:string,category:string>>",
    )
    pack = workflows.review_pack(rows, per_cell=3).collect()
    cells = {}
    for r in pack:
        cells[(r["cohort"], r["primary_category"])] = cells.get((r["cohort"], r["primary_category"]), 0) + 1
    assert cells == {(c, k): 3 for c in workflows.COHORTS for k in ("negation", "other")} and "r03" not in {r["review_id"] for r in pack}
    few = workflows.critical_candidates(rows, per_cell=2).collect()
    assert sorted(r["cohort"] for r in few) == ["busan", "busan", "gyeongsang_other", "gyeongsang_other"] and all(r["critical_categories"] == ["negation"] for r in few)


def test_speaker_split(spark):
    rows = [(f"in/{f}.json", f"{f}.{s}.{k}", f"s{s}", "busan_any" if f < 4 else "gyeongsang_other", 1 if k else 0, 4 + k) for f in range(8) for s in range(2) for k in range(4)]
    manifest = spark.createDataFrame(rows, "source_file string, utterance_id string, speaker_id string, slice_label string, dialect_count int, eojeol_count int")
    stems = lambda *xs: spark.createDataFrame([(str(x),) for x in xs], "stem string")
    got = workflows.speaker_split(manifest, stems(*range(7)), stems(0, 5), per_cohort=8, most_per_speaker=2).collect()
    busan = [r for r in got if r["cohort"] == "busan"]
    assert {r["stem"] for r in busan} == {"1", "2", "3"} and len(busan) == 8 and {r["stem"] for r in got} - {"1", "2", "3"} == {"4", "6"}
    assert len({r["speaker_key"] for r in busan}) == 6 and all(r["dialect_count"] and r["eojeol_count"] >= 5 and r["review_id"].startswith("holdout-") for r in got)


def test_significance(spark):
    rows = [(f"r{i:02d}", "busan", 2, i % 3 % 2, 10, i % 4 % 3) for i in range(30)]
    clusters = spark.createDataFrame(rows, "review_id string, cohort string, dialect_total long, dialect_error long, plain_total long, plain_error long")
    r = workflows.significance(clusters, draws=200).first()
    assert (r["dialect_total"], r["dialect_error"]) == (60, 10) and r["design_effect"] == pytest.approx((r["difference_se"] / r["naive_se"]) ** 2)
    assert r["difference_ci"][0] < r["difference"] < r["difference_ci"][1] and r["mh_lower"] < r["mh_odds_ratio"] < r["mh_upper"]


def test_cleaned_tokens(spark):
    rows = ["a,b  c! d%　(e)", "  ", "", None, "?! 가나 다\u0085라"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(cleaned_tokens("t")).collect()]
    assert got == [["a,b", "c", "d%", "e"], [], [], None, ["가나", "다", "라"]]
