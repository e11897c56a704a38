"""Validation of annotation rows: a schema is compiled to column predicates over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The annotation schema.
REQUIRED = ("utterance_id", "audio_path", "dialect_transcript", "standard_transcript", "domain", "intent", "critical_spans")
STRINGS = ("utterance_id", "audio_path", "speaker_region", "speaker_age_band", "acoustic_condition", "dialect_transcript", "standard_transcript", "domain", "intent", "notes")
ENUMS = {
    "acoustic_condition": ("clean", "telephone_bandlimited", "noise", "overlap", "fast_speech", "call_real", "unknown"),
    "domain": ("cancellation", "billing", "delivery", "reservation", "plan_change", "complaint", "technical_support", "other"),
}
ITEM_RULES = {
    "slots": {"required": ("name", "value"), "known": ("name", "value", "span_text"), "enums": {}},
    "critical_spans": {
        "required": ("span_text", "category", "business_risk"),
        "known": ("span_text", "category", "business_risk", "expected_asr_preservation"),
        "enums": {"category": ("negation", "amount", "date_time", "entity", "intent_cue", "confirmation", "other"), "business_risk": ("low", "medium", "high")},
    },
}
KNOWN = (*STRINGS, "slots", "critical_spans", "clarification_required")


def _error(path: Column | str, rule: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def violations(json_text: Column, *, required: tuple = REQUIRED, strings: tuple = STRINGS, enums: dict = ENUMS, items: dict = ITEM_RULES, known: tuple = KNOWN, booleans: tuple = ("clarification_required",), filled: tuple = ("critical_spans",)) -> Column:
    """array<struct<path, rule>> of all violations; rules: json, object, required, type, enum, minItems, additional.

    Text that is not JSON has one violation, `json`; JSON of another kind than an object one, `object`."""
    v = F.try_parse_json(json_text)
    there = lambda k: F.array_contains(F.json_object_keys(json_text), k)
    at = lambda k, t="variant": F.try_variant_get(v, f"$.{k}", t)
    kind = lambda k: F.schema_of_variant(at(k))
    checks = [F.when(~there(k), _error(k, "required")) for k in required]
    checks += [F.when(there(k) & ~F.coalesce(kind(k) == "STRING", F.lit(False)), _error(k, "type")) for k in strings]
    checks += [F.when(there(k) & ~F.coalesce(kind(k) == "BOOLEAN", F.lit(False)), _error(k, "type")) for k in booleans]
    checks += [F.when(there(k) & (kind(k) == "STRING") & ~at(k, "string").isin(*values), _error(k, "enum")) for k, values in enums.items()]
    out = [F.array_compact(F.array(*checks)), F.transform(F.array_except(F.json_object_keys(json_text), F.array(*map(F.lit, known))), lambda k: _error(k, "additional"))]
    for k, rule in items.items():
        is_array = F.coalesce(F.startswith(kind(k), F.lit("ARRAY")), F.lit(False))
        out.append(F.array_compact(F.array(F.when(there(k) & ~is_array, _error(k, "type")), F.when(is_array & (F.size(at(k, "array<variant>")) == 0), _error(k, "minItems")) if k in filled else F.lit(None).cast("struct<path:string,rule:string>"))))

        def item(x: Column, i: Column) -> Column:
            text, path = F.to_json(x), lambda f: F.format_string("%s/%d/%s", F.lit(k), i, F.lit(f))
            keys = F.json_object_keys(text)
            got = lambda f: F.try_variant_get(x, f"$.{f}", "variant")
            has = lambda f: F.array_contains(keys, f)
            parts = [F.when(~has(f), _error(path(f), "required")) for f in rule["required"]]
            parts += [F.when(has(f) & ~F.coalesce(_is_string(got(f)), F.lit(False)), _error(path(f), "type")) for f in rule["known"]]
            parts += [F.when(has(f) & _is_string(got(f)) & ~F.try_variant_get(x, f"$.{f}", "string").isin(*values), _error(path(f), "enum")) for f, values in rule["enums"].items()]
            parts += [F.when(F.size(F.array_except(keys, F.array(*map(F.lit, rule["known"])))) > 0, _error(path("*"), "additional"))]
            return F.when(keys.isNull(), F.array(_error(path(""), "type"))).otherwise(F.array_compact(F.array(*parts)))

        out.append(F.coalesce(F.flatten(F.transform(at(k, "array<variant>"), item)), F.array().cast("array<struct<path:string,rule:string>>")))
    nothing = F.json_object_keys(json_text).isNull()
    return F.when(v.isNull(), F.array(_error("", "json"))).when(nothing, F.array(_error("", "object"))).otherwise(F.concat(*out))


def coverage(rows: DataFrame, json_column: str) -> DataFrame:
    """One row: rows, valid and invalid ones, violations, the first rule in path order."""
    v = rows.select(violations(F.col(json_column)).alias("v"))
    return v.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("v") == 0).alias("valid"), F.count_if(F.size("v") > 0).alias("invalid"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("violations"), F.min(F.when(F.size("v") > 0, F.array_min("v"))).alias("first"))
