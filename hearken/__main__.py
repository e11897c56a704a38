"""The analyses from the command line: python -m hearken COMMAND INPUT... -o FOLDER

Results are JSON lines in a folder, written by Spark; a command of one row also prints it. Paths may be in any store that
Spark reads. Under spark-submit the session is the one of the cluster."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from hearken.operators import cohorts, review, scoring, validate
from hearken.plans import workflows
from hearken.sources import io

UNITS = "review_id string, utterance_id string, cohort string, dialect_units array<struct<category:string,dialect:string,standard:string>>, plain_units array<struct<standard:string>>"
HYPOTHESES = "review_id string, utterance_id string, hypothesis string"
QUEUE = "utterance_id string, audio_path string, speaker_region string, speaker_age_band string, acoustic_condition string, dialect_transcript string, standard_transcript string, candidate_spans array<struct<span_text:string,category:string>>"
AUDIT = "review_id string, unit_index long, utterance_id string, cohort string, category string, automatic_outcome string, text_audit_status string, text_audit_reason string, text_audit_note string, requires_audio_review boolean"
REVIEWED = f"review_id string, review_status string, final_annotation struct<{io.ANNOTATION}>"
SLICES = "source_file string, utterance_id string, speaker_id string, age string, sex string, slice_label string, dialect_count int, eojeol_count int, topic string"
STEMS = "stem string"


def _lines(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: io.read_jsonl(spark, path, schema)


def _numbered(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lines of which the last of repeated ones counts."""
    return lambda spark, path: io.read_jsonl_numbered(spark, path, schema)


def _dialogs(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of the dialogs in a folder, or in the zip archives of one whose path ends in .zip or /*.zip."""
    return cohorts.utterances(io.read_zip_json(spark, path) if path.endswith(".zip") else io.read_json_folder(spark, path))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _significance(manifest: DataFrame, asr: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Of all utterances with a hypothesis, whatever their cohort."""
    found = scoring.clusters(scoring.with_outcomes(manifest, asr))
    return workflows.significance(found.cache(), draws=args.draws)


def _losses(annotations: DataFrame, manifest: DataFrame, asr: DataFrame, args: argparse.Namespace) -> DataFrame:
    return scoring.span_losses(workflows.span_outcomes(annotations, manifest, asr), args.by)


def _split(slices: DataFrame, audio: DataFrame, pilot: DataFrame, args: argparse.Namespace) -> DataFrame:
    return workflows.speaker_split(slices, audio, pilot, per_cohort=args.per_cohort, most_per_speaker=args.max_per_speaker, least_eojeols=args.min_eojeols)


_gold, _asr = _lines(io.ANNOTATION), _numbered(HYPOTHESES)
#: name: (readers of the inputs, function of their tables and the options, whether the result is one row)
COMMANDS: dict[str, tuple[dict, Callable, bool]] = {
    "evaluate": ({"gold": _numbered(io.ANNOTATION), "asr": _lines(io.ASR)}, lambda gold, asr, _: scoring.evaluate(gold, asr), False),
    "slices": ({"dialogs": _dialogs}, lambda rows, _: rows.drop("eojeols"), False),
    "slice-summary": ({"dialogs": _dialogs}, lambda rows, _: cohorts.slice_summary(rows), False),
    "topics": ({"dialogs": _dialogs}, lambda rows, _: cohorts.topic_counts(rows), False),
    "taxonomy": ({"dialogs": _dialogs}, lambda rows, _: cohorts.taxonomy(rows), False),
    "preannotate": ({"queue": _lines(QUEUE)}, lambda rows, _: workflows.preannotate(rows), False),
    "remine": ({"annotations": _gold}, lambda rows, _: workflows.remine(rows).drop("old_spans"), False),
    "phantoms": ({"annotations": _gold}, lambda rows, _: workflows.phantom_rates(rows), True),
    "freeze": ({"queue": _lines(REVIEWED)}, lambda rows, _: review.freeze(rows), False),
    "validate": ({"annotations": _documents}, lambda rows, _: validate.coverage(rows, "value"), True),
    "probe": ({"manifest": _lines(UNITS), "asr": _asr}, lambda m, a, _: workflows.probe_rates(m, a), True),
    "outcomes": ({"manifest": _lines(UNITS), "asr": _asr}, lambda m, a, _: workflows.outcome_counts(workflows.unit_outcomes(m, a)), False),
    "significance": ({"manifest": _lines(UNITS), "asr": _asr}, _significance, True),
    "spans": ({"annotations": _gold, "manifest": _numbered(UNITS), "asr": _asr}, lambda g, m, a, _: workflows.span_outcomes(g, m, a), False),
    "losses": ({"annotations": _gold, "manifest": _lines(UNITS), "asr": _asr}, _losses, False),
    "split": ({"slices": _lines(SLICES), "audio": _lines(STEMS), "pilot": _lines(STEMS)}, _split, False),
    "audio-review": ({"audit": _lines(AUDIT)}, lambda rows, _: review.audio_review(rows), False),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="hearken", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (inputs, _, _) in COMMANDS.items():
        one = commands.add_parser(name)
        for x in inputs:
            one.add_argument(x)
        one.add_argument("-o", "--output", required=True, help="folder for the result; it must not be there yet")
        if name == "significance":
            one.add_argument("--draws", type=int, default=10_000)
        if name == "losses":
            one.add_argument("--by", nargs="+", default=["category"], choices=["category", "cohort", "business_risk"])
        if name == "split":
            for option, value in (("--per-cohort", 150), ("--max-per-speaker", 2), ("--min-eojeols", 5)):
                one.add_argument(option, type=int, default=value)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("hearken").getOrCreate()
    inputs, run, one_row = COMMANDS[args.command]
    result = run(*[read(spark, getattr(args, name)) for name, read in inputs.items()], args)
    io.write_jsonl(result, args.output)
    if one_row:
        print(io.summary_json(spark.read.schema(result.schema).json(args.output)))


if __name__ == "__main__":
    main()
