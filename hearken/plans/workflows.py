"""Whole analyses, put together from the operators: each takes tables and returns a table, and nothing runs before an action.

Column names of inputs are those of `hearken.sources.io` and of the manifests that these functions return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.text import _col, bound, holds, normalized, stable_hash
from hearken.operators import cohorts, mining, sampling, scoring, stats
from hearken.operators.keyed import last_of

# The two cohorts that are compared, and the note of a re-mined row.
COHORTS = ("busan", "gyeongsang_other")
REMINED = "remined_with=eojeol_boundary_rules_v2"


def _filled(column: Column | str) -> Column:
    return F.coalesce(_col(column), F.lit(""))


# ---- choosing what is annotated ------------------------------------------------------------------------------------


def review_pack(rows: DataFrame, *, per_cell: int = 50, seed: int = 119) -> DataFrame:
    """Dialect-marked utterances for review: up to per_cell of each cohort and primary category.

    rows: review_id, slice_label, eojeols, hints array<string>. Utterances without hints have the category `other`."""
    kept = cohorts.review_candidates(rows).withColumn("cohort", cohorts.cohort("slice_label"))
    primary = sampling.primary_label(kept, ["review_id"], "hints", "primary_category")
    kept = kept.join(primary, "review_id", "left").withColumn("primary_category", F.coalesce("primary_category", F.lit("other")))
    return sampling.stratified(kept, ["cohort", "primary_category"], "review_id", per_cell, seed)


def critical_candidates(rows: DataFrame, *, per_cell: int = 40, seed: int = 119) -> DataFrame:
    """Dialect-marked utterances with critical spans: up to per_cell of each cohort and category, each utterance once.

    rows: review_id, slice_label, eojeols, critical_spans array<struct<span_text, category>>."""
    kept = cohorts.review_candidates(rows, with_critical=True).withColumn("cohort", cohorts.cohort("slice_label"))
    kept = kept.withColumn("critical_categories", F.array_sort(F.array_distinct(F.transform("critical_spans", lambda s: s["category"]))))
    return sampling.stratified_by_labels(kept, ["cohort"], "critical_categories", "review_id", per_cell, seed)


def speaker_split(manifest: DataFrame, audio: DataFrame, pilot: DataFrame, *, per_cohort: int = 150, most_per_speaker: int = 2, least_eojeols: int = 5) -> DataFrame:
    """A held-out set whose recordings have audio and are not in the pilot, dealt by rounds over the speakers.

    manifest: what `cohorts.utterances` returns. audio and pilot have the column `stem`, names of recordings without
    suffix. A speaker is a speaker of one recording."""
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    pool = manifest.withColumns({"stem": stem, "cohort": cohorts.cohort("slice_label")})
    pool = pool.filter(F.col("cohort").isin(*COHORTS) & (F.col("dialect_count") >= 1) & (F.col("eojeol_count") >= least_eojeols))
    pool = pool.join(audio.select("stem"), "stem", "left_semi").join(pilot.select("stem"), "stem", "left_anti")
    name = F.concat(F.lit("holdout-"), stable_hash(F.concat_ws(":", "source_file", "utterance_id")))
    pool = pool.withColumns({"review_id": name, "speaker_key": F.concat_ws(":", "source_file", "speaker_id")})
    return sampling.round_robin(pool, "cohort", "speaker_key", "review_id", per_cohort, most_per_speaker)


# ---- annotating ----------------------------------------------------------------------------------------------------


def preannotate(rows: DataFrame) -> DataFrame:
    """Weak annotations of the rows in which a critical span is found: spans with their risk, domain, intent and slots.

    rows: utterance_id, audio_path, speaker_region, speaker_age_band, acoustic_condition, both transcripts and
    candidate_spans array<struct<span_text, category>> (null: none)."""
    both = F.concat_ws(" ", _filled("standard_transcript"), _filled("dialect_transcript"))
    hinted = F.coalesce(F.col("candidate_spans"), F.array().cast(mining.SPANS))
    out = rows.withColumn("_spans", mining.merged_spans(_filled("standard_transcript"), _filled("dialect_transcript"), hinted)).filter(F.size("_spans") > 0)
    out = out.withColumns({"domain": mining.domain(both), "slots": mining.slots(F.col("_spans")), "critical_spans": mining.with_risk(F.col("_spans"))})
    note = F.format_string("weak_preannotation_id=%s; human_review_required=true", stable_hash(_filled("utterance_id")))
    out = out.withColumns({"intent": mining.intent(F.col("domain")), "clarification_required": F.lit(True), "notes": note})
    names = ("utterance_id", "audio_path", "speaker_region", "speaker_age_band", "acoustic_condition", "dialect_transcript", "standard_transcript", "domain", "intent", "slots", "critical_spans", "clarification_required", "notes")
    return out.select(*names)


def remine(annotations: DataFrame) -> DataFrame:
    """Annotations with spans and slots mined anew by word boundaries; the former ones stay as `old_spans`."""
    both = F.trim(F.concat_ws(" ", _filled("standard_transcript"), _filled("dialect_transcript")))
    note = F.when(_filled("notes") == "", F.lit(REMINED)).otherwise(F.concat_ws("; ", "notes", F.lit(REMINED)))
    out = annotations.withColumn("old_spans", F.col("critical_spans")).withColumn("_spans", mining.boundary_spans(both))
    return out.withColumns({"critical_spans": mining.with_risk(F.col("_spans")), "slots": mining.slots(F.col("_spans")), "notes": note}).drop("_spans")


def phantom_rates(annotations: DataFrame, spans: str = "critical_spans") -> DataFrame:
    """One row: spans, those that no transcript grounds, their share (0 without spans)."""
    each = annotations.select("standard_transcript", "dialect_transcript", F.explode(spans).alias("_s"))
    phantom = ~scoring.grounded(_filled("_s.span_text"), [_filled("standard_transcript"), _filled("dialect_transcript")])
    out = each.agg(F.count(F.lit(1)).alias("spans"), F.count_if(phantom).alias("phantom_labels"))
    return out.withColumn("phantom_rate", F.coalesce(F.try_divide("phantom_labels", "spans"), F.lit(0.0)))


# ---- measuring -----------------------------------------------------------------------------------------------------


def unit_outcomes(manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """(review_id, cohort, category, outcome, n): how the units of each utterance with a hypothesis came through. Units that
    are not dialect have the category `plain` and the outcome preserved or plain_error.

    manifest: review_id, utterance_id, cohort, dialect_units array<struct<category, dialect, standard>>, plain_units
    array<struct<standard>>."""
    found = scoring.with_outcomes(manifest, asr).filter("hypothesis is not null")

    def graded(h: Column) -> Column:
        of = lambda category, outcome: F.struct(category.alias("category"), outcome.alias("outcome"))
        dialect = lambda u: of(_filled(u["category"]), F.when(holds(h, u["dialect"]), "surface_preserved").when(holds(h, u["standard"]), "standard_normalized").otherwise("missing_or_substituted"))
        plain = lambda u: of(F.lit("plain"), F.when(holds(h, u["standard"]), "preserved").otherwise("plain_error"))
        return F.concat(F.transform("dialect_units", dialect), F.transform("plain_units", plain))

    each = found.select("review_id", "cohort", F.explode(bound(normalized("hypothesis"), graded)).alias("_u"))
    return each.groupBy("review_id", "cohort", "_u.category", "_u.outcome").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes in all, by cohort and by category in one pass; `grain` is the grouping id."""
    c = F.col
    sets = [[c("outcome")], [c("cohort"), c("outcome")], [c("category"), c("outcome")]]
    return outcomes.groupingSets(sets, "cohort", "category", "outcome").agg(F.sum("n").alias("n"), F.grouping_id().alias("grain"))


def probe_rates(manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """One row over the two cohorts: utterances with and without a hypothesis, and the shares of dialect units lost, of
    those that do not keep their surface, and of plain units lost (0 where there is no unit)."""
    n = lambda *outcomes: F.coalesce(F.sum(F.when(F.col("outcome").isin(*outcomes), F.col("n"))), F.lit(0))
    units = unit_outcomes(manifest, asr).filter(F.col("cohort").isin(*COHORTS))
    sums = units.agg(n("surface_preserved").alias("_kept"), n("standard_normalized").alias("_standard"), n("missing_or_substituted").alias("_lost"), n("preserved").alias("_plain"), n("plain_error").alias("_error"))
    met = scoring.with_outcomes(manifest, asr).agg(F.count_if(F.col("hypothesis").isNotNull() & F.col("cohort").isin(*COHORTS)).alias("evaluated_utterances"), F.count_if(F.col("hypothesis").isNull()).alias("missing_asr_outputs"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    dialect, kept, lost, error = F.col("_kept") + F.col("_standard") + F.col("_lost"), F.col("_kept"), F.col("_lost"), F.col("_error")
    rates = {"dialect_unit_error_rate": share(lost, dialect), "dialect_surface_change_rate": share(dialect - kept, dialect), "plain_unit_error_rate": share(error, F.col("_plain") + error)}
    return met.join(F.broadcast(sums), F.lit(True)).withColumns(rates).select("evaluated_utterances", "missing_asr_outputs", *rates)  # one row each


def _graded_spans(critical: Column, slots: Column | None) -> Column:
    """Critical spans, then slots (their text, else their value), as array<struct<span_text, category, business_risk, source>>;
    those without a text are left out."""
    def one(text: Column, category: Column, risk: Column, source: str) -> Column:
        return F.struct(_filled(text).alias("span_text"), category.alias("category"), risk.alias("business_risk"), F.lit(source).alias("source"))

    spans = F.coalesce(F.transform(critical, lambda s: one(s["span_text"], s["category"], s["business_risk"], "critical_span")), F.array())
    if slots is not None:
        text = lambda s: F.when(_filled(s["span_text"]) != "", s["span_text"]).otherwise(s["value"])
        spans = F.concat(spans, F.coalesce(F.transform(slots, lambda s: one(text(s), s["name"], F.lit("unspecified"), "slot")), F.array()))
    return F.filter(spans, lambda s: s["span_text"] != "")


def _measured(annotations: DataFrame, manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """annotations with review_id, cohort, dialect_units and hypothesis, null where the manifest or the hypotheses have none;
    of repeated rows of either the last counts."""
    units = last_of(manifest, "utterance_id").select("utterance_id", "review_id", "cohort", "dialect_units")
    heard = last_of(asr, "review_id").select("review_id", _filled("hypothesis").alias("hypothesis"))
    return annotations.join(units, "utterance_id", "left").join(heard, "review_id", "left")


def span_outcomes(annotations: DataFrame, manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """One row for each critical span and slot of the annotations whose utterance has a hypothesis, with its source, its match
    type and whether it is dialect-marked; empty ones are left out. annotations join the manifest by utterance_id, the
    manifest the hypotheses by review_id; what neither joins is counted by `skipped_annotations`."""
    spans = _graded_spans(F.col("critical_spans"), F.col("slots") if "slots" in annotations.columns else None)
    found = annotations.select("utterance_id", "standard_transcript", "dialect_transcript", spans.alias("_spans"))
    each = _measured(found, manifest, asr).filter("hypothesis is not null").withColumn("_s", F.explode("_spans"))
    graded = scoring.match_type("_s.span_text", "hypothesis", [_filled("dialect_transcript"), _filled("standard_transcript")])
    marked = F.coalesce(scoring.dialect_marked("_s.span_text", "dialect_units"), F.lit(False))
    return each.select("review_id", "utterance_id", "cohort", "_s.span_text", "_s.category", "_s.business_risk", "_s.source", marked.alias("dialect_marked"), graded.alias("match_type"))


def skipped_annotations(annotations: DataFrame, manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """One row: annotations, and those that have no row of the manifest or no hypothesis."""
    found = _measured(annotations.select("utterance_id"), manifest, asr)
    return found.agg(F.count(F.lit(1)).alias("annotations"), F.count_if(F.col("hypothesis").isNull()).alias("skipped"))


def significance(clusters: DataFrame, *, draws: int = 10_000, key: str = "review_id") -> DataFrame:
    """One row of one model: rates, z test, Wald and Mantel-Haenszel intervals, exact permutation null, bootstrap intervals
    and the design effect. clusters: what `scoring.clusters` returns; it is read several times, so cache or write it."""
    z, boot = stats.two_proportion(clusters), stats.bootstrap(clusters, key, draws)
    out = stats.rates(clusters)
    parts = [z.drop("difference"), stats.wald_interval(clusters), stats.mantel_haenszel(clusters), stats.permutation_null(clusters).drop("observed_difference"), boot]
    for part in parts:
        fresh = [c for c in part.columns if c not in out.columns]
        out = out.join(F.broadcast(part.select(*fresh)), F.lit(True))  # one row each
    return out.withColumn("design_effect", F.pow(F.try_divide("difference_se", "naive_se"), 2))
