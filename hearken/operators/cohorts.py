"""Region slices, cohorts, manifests of utterances, and counts over several grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.hangul import classify_pair, signature
from hearken.functions.text import _col, stable_hash
from hearken.operators.keyed import LINE, last_of

# Regions and slices.
BUSAN = "부산"
REGIONS = ("부산", "대구", "울산", "경북", "경남")
BUSAN_SLICES = ("busan_strict", "busan_residence", "busan_any")


def slice_label(birth: Column | str, principal: Column | str, current: Column | str, *, core: str = BUSAN, regions: tuple = REGIONS, names: tuple = (*BUSAN_SLICES, "gyeongsang_other", "other")) -> Column:
    """The first rule that holds of three regions; nulls match none."""
    b, p, c = (F.coalesce(_col(x), F.lit("")) for x in (birth, principal, current))
    near = b.isin(*regions) | p.isin(*regions) | c.isin(*regions)
    return F.when((b == core) & (p == core) & (c == core), names[0]).when((p == core) | (c == core), names[1]).when(b == core, names[2]).when(near, names[3]).otherwise(names[4])


def cohort(label: Column | str) -> Column:
    x = _col(label)
    return F.when(x.isin(*BUSAN_SLICES), "busan").when(x == "gyeongsang_other", "gyeongsang_other").otherwise("other")


def first_filled(*columns: Column | str, default: str = "unknown") -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in columns], F.lit(default))


def transcript(dialect_form: Column | str, form: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(dialect_form), F.lit("")), _col(form), F.lit(""))


def utterances(dialogs: DataFrame) -> DataFrame:
    """Dialogs (source_file, speaker[], utterance[]) to one row for each utterance with its speaker; utterances whose
    speaker is not listed are dropped, of repeated speaker ids the last counts."""
    rows = dialogs.withColumn("u", F.explode("utterance"))
    speaker = F.try_element_at(F.filter("speaker", lambda s: s["id"] == F.col("u.speaker_id")), F.lit(-1))
    rows = rows.withColumn("s", speaker).filter("s is not null")
    marked = F.filter("u.eojeolList", lambda e: e["isDialect"])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    topic = text("metadata.topic") if "metadata" in dialogs.columns else F.lit("")
    return rows.select(
        "source_file",
        F.col("u.id").alias("utterance_id"),
        F.col("u.speaker_id").alias("speaker_id"),
        *[F.col(f"s.{c}").alias(c) for c in ("age", "sex", "birthplace", "principal_residence", "current_residence")],
        slice_label("s.birthplace", "s.principal_residence", "s.current_residence").alias("slice_label"),
        F.char_length(text("u.dialect_form")).alias("dialect_length"),
        F.char_length(text("u.standard_form")).alias("standard_length"),
        F.coalesce(F.size(marked), F.lit(0)).alias("dialect_count"),
        F.coalesce(F.size("u.eojeolList"), F.lit(0)).alias("eojeol_count"),
        (F.coalesce(F.size(marked), F.lit(0)) > 0).alias("has_dialect"),
        F.col("u.eojeolList").alias("eojeols"),
        topic.alias("topic"),
    )


def slice_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("slice_label").agg(F.count(F.lit(1)).alias("utterances"), F.sum("dialect_count").alias("dialect_eojeols"), F.sum("eojeol_count").alias("eojeols"), F.count_if("has_dialect").alias("dialect_utterances"))


def topic_counts(manifest: DataFrame) -> DataFrame:
    """Utterances of each slice and topic; those without a topic are not counted."""
    return manifest.filter("topic <> ''").groupBy("slice_label", "topic").agg(F.count(F.lit(1)).alias("utterances"))


def with_slices(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows with the slice of (source_file, utterance_id), `other` where the manifest has none."""
    known = manifest.select("source_file", "utterance_id", F.col("slice_label").alias("_slice"), *[c for c in manifest.columns if c == LINE])
    known = last_of(known, "source_file", "utterance_id")
    return rows.join(known, ["source_file", "utterance_id"], "left").withColumn("slice_label", F.coalesce("_slice", F.lit("other"))).drop("_slice")


def taxonomy(rows: DataFrame) -> DataFrame:
    """Counts of dialect pairs at four grains in one pass: cohort; cohort and category; slice and category; pattern.
    rows: slice_label, eojeols array<struct<eojeol, standard, isDialect>>. `grain` is the grouping id."""
    pairs = rows.select("slice_label", F.explode(F.filter("eojeols", lambda e: e["isDialect"])).alias("e"))
    pairs = pairs.select(cohort("slice_label").alias("cohort"), "slice_label", F.coalesce("e.standard", F.lit("")).alias("standard"), F.coalesce("e.eojeol", F.lit("")).alias("dialect"))
    pairs = pairs.select("cohort", "slice_label", classify_pair("standard", "dialect").alias("category"), signature("standard", "dialect").alias("signature"), stable_hash(F.concat_ws("\t", "standard", "dialect")).alias("pair_hash"))
    c = F.col
    sets = [[c("cohort")], [c("cohort"), c("category")], [c("slice_label"), c("category")], [c("cohort"), c("slice_label"), c("category"), c("signature"), c("pair_hash")]]
    keys = ["cohort", "slice_label", "category", "signature", "pair_hash"]
    return pairs.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grain"))


def review_candidates(rows: DataFrame, *, with_critical: bool = False) -> DataFrame:
    """Rows with a pair of two filled sides, outside cohort `other`; with_critical also asks for a critical span."""
    usable = F.exists("eojeols", lambda e: e["isDialect"] & (F.coalesce(e["eojeol"], F.lit("")) != "") & (F.coalesce(e["standard"], F.lit("")) != ""))
    out = rows.filter((cohort("slice_label") != "other") & usable)
    return out.filter(F.size("critical_spans") > 0) if with_critical else out


def document_profile(documents: DataFrame, json_column: str, *, count_keys: tuple = (), value_keys: tuple = ()) -> DataFrame:
    """(kind, key, value, n) over JSON documents of any shape: how often each of count_keys occurs at any depth with a
    non-null value, and how often each string value of value_keys occurs.

    Strings in JSON are read by one scan for `"key":` followed by a value, so depth does not matter."""
    text = F.col(json_column)
    parts = [documents.select(F.lit("field").alias("kind"), F.lit(k).alias("key"), F.lit(None).cast("string").alias("value"), F.regexp_count(text, F.lit(rf'"{k}"\s*:\s*(?!null)')).alias("n")) for k in count_keys]
    parts += [documents.select(F.explode(F.regexp_extract_all(text, F.lit(rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))).alias("value")).select(F.lit("value").alias("kind"), F.lit(k).alias("key"), "value", F.lit(1).alias("n")) for k in value_keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "key", "value").agg(F.sum("n").alias("n"))
