"""The command line over small files."""

import json

import pytest

from hearken import __main__ as cli


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def found(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    gold = {"utterance_id": "u1", "dialect_transcript": "해지 안 된다", "standard_transcript": "해지 안 된다", "intent": "x", "slots": [], "critical_spans": [{"span_text": "해지", "category": "intent_cue"}, {"span_text": "안", "category": "negation"}]}
    unit = {"category": "vowel_shift", "dialect": "바까도", "standard": "바꿔도"}
    dialog = {"id": "d", "speaker": [{"id": "s", "birthplace": "부산", "principal_residence": "부산", "current_residence": "부산"}], "metadata": {"topic": "t"}, "utterance": [{"id": "d.1", "form": "가", "standard_form": "가나", "dialect_form": "가너", "speaker_id": "s", "eojeolList": [{"id": 1, "eojeol": "바까도", "standard": "바꿔도", "isDialect": True}]}]}
    (at / "dialogs").mkdir()
    return {
        "gold": lines(at / "gold.jsonl", gold),
        "asr": lines(at / "asr.jsonl", {"utterance_id": "u1", "review_id": "r1", "model": "m", "hypothesis": "해지 된다", "intent_prediction": "x", "slots": []}),
        "units": lines(at / "units.jsonl", {"review_id": "r1", "utterance_id": "u1", "cohort": "busan", "dialect_units": [unit], "plain_units": [{"standard": "해지"}, {"standard": "안"}]}),
        "other": lines(at / "other.jsonl", {"review_id": "r1", "utterance_id": "u1", "cohort": "other", "dialect_units": [unit], "plain_units": [{"standard": "해지"}]}),
        "queue": lines(at / "queue.jsonl", {"review_id": "r1", "review_status": "accepted", "final_annotation": gold}, {"review_id": "r2", "review_status": "rejected", "final_annotation": gold}),
        "dialogs": str((at / "dialogs", lines(at / "dialogs" / "d.json", dialog))[0]),
        "slices": lines(at / "slices.jsonl", {"source_file": "a.json", "utterance_id": "a.1", "speaker_id": "s", "slice_label": "busan_any", "dialect_count": 1, "eojeol_count": 9}),
        "audio": lines(at / "audio.jsonl", {"stem": "a"}),
        "pilot": lines(at / "pilot.jsonl", {"stem": "b"}),
        "audit": lines(at / "audit.jsonl", *[{"review_id": r, "unit_index": 0, "text_audit_status": s} for r, s in (("b", "low_impact_discourse_or_hedge_loss"), ("a", "none"), ("c", "potentially_harmful_semantic_shift"))]),
    }


@pytest.mark.parametrize(
    ("command", "inputs", "options", "wanted"),
    [
        ("evaluate", ["gold", "asr"], [], [{"model": "m", "intent_accuracy": 1.0, "critical_error_rate": 0.5}]),
        ("slices", ["dialogs"], [], [{"source_file": "d.json", "utterance_id": "d.1", "slice_label": "busan_strict", "dialect_count": 1}]),
        ("slice-summary", ["dialogs"], [], [{"slice_label": "busan_strict", "utterances": 1, "dialect_eojeols": 1}]),
        ("topics", ["dialogs"], [], [{"slice_label": "busan_strict", "topic": "t", "utterances": 1}]),
        ("taxonomy", ["dialogs"], [], None),
        ("preannotate", ["gold"], [], [{"utterance_id": "u1", "domain": "cancellation"}]),
        ("remine", ["gold"], [], [{"utterance_id": "u1", "slots": [{"name": "intent_cue", "value": "해지", "span_text": "해지"}]}]),
        ("phantoms", ["gold"], [], [{"spans": 2, "phantom_labels": 0, "phantom_rate": 0.0}]),
        ("freeze", ["queue"], [], [{"review_id": "r1", "utterance_id": "u1"}]),
        ("validate", ["gold"], [], [{"rows": 1, "valid": 0, "invalid": 1}]),
        ("probe", ["units", "asr"], [], [{"evaluated_utterances": 1, "dialect_unit_error_rate": 1.0, "plain_unit_error_rate": 0.5}]),
        ("outcomes", ["units", "asr"], [], None),
        ("significance", ["units", "asr"], ["--draws", "50"], [{"dialect_rate": 1.0, "plain_rate": 0.5}]),
        ("significance", ["other", "asr"], ["--draws", "20"], [{"dialect_total": 1, "plain_rate": 0.0}]),
        ("spans", ["gold", "units", "asr"], [], None),
        ("losses", ["gold", "units", "asr"], ["--by", "cohort"], [{"cohort": "busan", "labelled": 2, "absent": 1, "strict_loss": 0.5}]),
        ("split", ["slices", "audio", "pilot"], ["--per-cohort", "1"], [{"stem": "a", "cohort": "busan", "taken": 1}]),
        ("audio-review", ["audit"], [], [{"review_id": "c"}, {"review_id": "b"}]),
    ],
)
def test_command(spark, files, tmp_path, capsys, command, inputs, options, wanted):
    cli.main([command, *[files[x] for x in inputs], "-o", str(tmp_path / "out"), *options], spark)
    rows = found(tmp_path / "out")
    assert rows
    if wanted is not None:
        assert [{k: r.get(k) for k in w} for r, w in zip(rows, wanted, strict=True)] == wanted
    printed = capsys.readouterr().out
    assert not cli.COMMANDS[command][2] or json.loads(printed)


def test_every_command_is_tested():
    assert set(cli.COMMANDS) == set(test_command.pytestmark[0].args[1][i][0] for i in range(len(test_command.pytestmark[0].args[1])))
