"""Scoring of hypotheses: unit outcomes, grading of spans, micro-averaged model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.numerals import DIGITS, numeric_values
from hearken.functions.text import _col, bound, characters, contains_normalized, holds, normalized, word_edits, words
from hearken.operators.keyed import last_of


def unit_outcome(hypothesis: Column | str, dialect: Column | str, standard: Column | str) -> Column:
    """How a dialect unit came through: as spoken, as its standard form, or not."""
    return F.when(contains_normalized(hypothesis, dialect), "surface_preserved").when(contains_normalized(hypothesis, standard), "standard_normalized").otherwise("missing_or_substituted")


def plain_error(hypothesis: Column | str, standard: Column | str) -> Column:
    return ~contains_normalized(hypothesis, standard)


def opens_token(text: Column | str, needle: Column) -> Column:
    """Whether a token of the text, normalised, starts with the needle, which must not be empty."""
    return (needle != "") & F.exists(words(text), lambda w: F.startswith(normalized(w), needle))


def grounded(span: Column | str, references: list[Column]) -> Column:
    """Whether a label can be scored: it has a number, or opens a token of a reference."""
    needle = normalized(span)
    opens = F.lit(False)
    for r in references:
        opens = opens | opens_token(r, needle)
    return (needle != "") & ((F.size(numeric_values(span)) > 0) | opens)


def match_type(span: Column | str, hypothesis: Column | str, references: list[Column]) -> Column:
    """phantom_label, numeral_equivalent, eojeol_initial, substring_only, unresolved_numeral or absent."""
    needle = normalized(span)
    numbers = numeric_values(span)
    shares = F.arrays_overlap(numbers, numeric_values(hypothesis))
    digits = "[" + "".join(DIGITS) + "]"
    return (
        F.when(~grounded(span, references), "phantom_label")
        .when(F.size(numbers) > 0, F.when(shares, "numeral_equivalent").otherwise("absent"))
        .when(opens_token(hypothesis, needle), "eojeol_initial")
        .when(F.contains(normalized(hypothesis), needle), "substring_only")
        .when(_col(span).rlike(digits), "unresolved_numeral")
        .otherwise("absent")
    )


def overlaps(a: Column | str, b: Column | str) -> Column:
    """Containment either way after normalisation, neither side empty."""
    x, y = normalized(a), normalized(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def dialect_marked(span: Column | str, units: Column | str) -> Column:
    """Whether a span overlaps the surface of a unit (array<struct<dialect, ...>>) of its utterance."""
    return F.exists(_col(units), lambda u: overlaps(_col(span), u["dialect"]))


def span_losses(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and loss rates of match types by group, of the spans that can be scored: strict counts those that are absent,
    inclusive also the ambiguous ones. A group without such spans has null rates."""
    is_ = lambda *k: F.count_if(F.col("match_type").isin(*k))
    out = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labelled"),
        is_("phantom_label").alias("phantom"),
        is_("numeral_equivalent", "eojeol_initial").alias("preserved"),
        is_("substring_only", "unresolved_numeral").alias("ambiguous"),
        is_("absent").alias("absent"),
    )
    scorable = F.col("labelled") - F.col("phantom")
    return out.withColumn("scorable", scorable).withColumn("strict_loss", F.try_divide("absent", scorable)).withColumn("inclusive_loss", F.try_divide(scorable - F.col("preserved"), scorable))


def evaluate(gold: DataFrame, asr: DataFrame) -> DataFrame:
    """Metrics of each model: error rates of characters and words, intent accuracy, slot precision, recall and F1, the rate of
    critical spans lost, overall and by category. Undefined rates are 0.

    A row of asr without gold is an error; of repeated gold ids the last counts."""
    pair = lambda s: F.array_distinct(F.transform(s, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))
    g = last_of(gold, "utterance_id").select("utterance_id", F.col("dialect_transcript").alias("reference"), F.col("intent").alias("gold_intent"), pair("slots").alias("gold_slots"), "critical_spans", F.lit(True).alias("has_gold"))
    r = asr.select("utterance_id", "model", "hypothesis", "intent_prediction", pair("slots").alias("slots")).join(g, "utterance_id", "left")
    r = r.withColumn("has_gold", F.when(F.col("has_gold").isNull(), F.raise_error(F.format_string("no gold row for %s", "utterance_id")).cast("boolean")).otherwise(True)).filter("has_gold")
    r = r.withColumn("rw", words("reference")).withColumn("hw", words("hypothesis"))
    size = lambda c: F.size(c).cast("long")
    r = r.select(
        "model",
        F.levenshtein(characters("reference"), characters("hypothesis")).alias("char_edits"),
        F.char_length(characters("reference")).alias("chars"),
        word_edits("rw", "hw").alias("word_edits"),
        size("rw").alias("words"),
        (F.col("gold_intent") == F.col("intent_prediction")).cast("int").alias("intent_hit"),
        size(F.array_intersect("slots", "gold_slots")).alias("tp"),
        size(F.array_except("slots", "gold_slots")).alias("fp"),
        size(F.array_except("gold_slots", "slots")).alias("fn"),
        F.transform("critical_spans", lambda s: F.struct(s["category"].alias("category"), (~F.contains(F.col("hypothesis"), s["span_text"])).cast("int").alias("lost"))).alias("spans"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    whole = r.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("char_edits", "chars", "word_edits", "words", "intent_hit", "tp", "fp", "fn")], F.count(F.lit(1)).alias("n"))
    spans = r.select("model", F.explode("spans").alias("s")).groupBy("model", "s.category").agg(F.sum("s.lost").alias("lost"), F.count(F.lit(1)).alias("total"))
    spans = spans.groupBy("model").agg(F.sum("lost").alias("lost"), F.sum("total").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", (F.col("lost") / F.col("total")).alias("rate"))))).alias("critical_by_category"))
    p, q = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return whole.join(spans, "model", "left").select(
        "model",
        "n",
        ratio(F.col("char_edits"), F.col("chars")).alias("cer"),
        ratio(F.col("word_edits"), F.col("words")).alias("wer"),
        ratio(F.col("intent_hit"), F.col("n")).alias("intent_accuracy"),
        p.alias("slot_precision"),
        q.alias("slot_recall"),
        ratio(2 * p * q, p + q).alias("slot_f1"),
        ratio(F.col("lost"), F.col("total")).alias("critical_error_rate"),
        "critical_by_category",
    )


def with_outcomes(manifest: DataFrame, asr: DataFrame) -> DataFrame:
    """manifest with the hypothesis found by review_id, else by utterance_id: two equi joins, no OR condition."""
    by = lambda key: last_of(asr, key).select(F.col(key).alias(f"_{key}"), F.col("hypothesis").alias(f"_by_{key}"))
    out = manifest.join(by("review_id"), F.col("review_id") == F.col("_review_id"), "left").join(by("utterance_id"), F.col("utterance_id") == F.col("_utterance_id"), "left")
    return out.withColumn("hypothesis", F.coalesce("_by_review_id", "_by_utterance_id")).drop("_review_id", "_utterance_id", "_by_review_id", "_by_utterance_id")


def clusters(matched: DataFrame) -> DataFrame:
    """Four counts for each utterance with a hypothesis: units and errors, dialect and plain. No shuffle; the hypothesis is
    normalised once for an utterance, not once for each of its units."""
    normal = normalized("hypothesis")
    lost = lambda h, u: ~F.coalesce(holds(h, u["dialect"]) | holds(h, u["standard"]), F.lit(False))
    failed = lambda units, test: bound(normal, lambda h: F.size(F.filter(units, lambda u: test(h, u))))
    return matched.filter("hypothesis is not null").select(
        "review_id",
        "cohort",
        F.size("dialect_units").alias("dialect_total"),
        failed("dialect_units", lost).alias("dialect_error"),
        F.size("plain_units").alias("plain_total"),
        failed("plain_units", lambda h, u: ~holds(h, u["standard"])).alias("plain_error"),
    )
