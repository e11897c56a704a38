"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and telephone numbers, reported whatever their
score. The method adds account numbers confirmed by mod-97 and nine-digit identity numbers, the latter only where
context lifts their score to LEAST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.spans import cut, digits_of, find_spans, joined, let, luhn, mod97, pieces

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Code points before and after a span in which context words count.
BEFORE, AFTER, LEAST = 48, 24, 0.5

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Score without context, words that raise it, words that lower it; they stand near the span.
CONTEXT = {
    "email": (0.9, r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b", r"(?i)\b(?:example|noreply)\b"),
    "ip": (0.6, r"(?i)\b(?:ip|address|host|server|login|from)\b", r"(?i)\b(?:version|release|section|v)\b"),
    "card": (0.7, r"(?i)\b(?:card|visa|credit|debit|payment|cvv|expir\w*)\b", r"(?i)\b(?:order|invoice|isbn|tracking|serial)\b"),
    "phone": (0.6, r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp|sms)\b", r"(?i)\b(?:order|serial|part)\b"),
    "iban": (0.9, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", r"(?i)\b(?:order|serial)\b"),
    "ssn": (0.3, r"(?i)\b(?:ssn|social|security|identity|tax)\b", r"(?i)\b(?:order|part|serial|phone)\b"),
}


def _between(m: Column, least: int, most: int) -> Column:
    return F.length(digits_of(m)).between(least, most)


def find_personal(docs: DataFrame) -> DataFrame:
    """docs with `found`: array<struct<k, s, e, kind, score>> sorted by kind as in KINDS, then start.

    Null texts count as empty, and give an empty array. Base kinds are the leftmost non-overlapping matches of their
    patterns that pass their test; a match that fails is dropped and its characters are not tried again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    numbers = text.rlike("[0-9][ -]?[0-9]")
    out = docs.withColumn("_email", find_spans(text, EMAIL, None, text.contains("@")))
    out = out.withColumn("_ip", find_spans(text, IP, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), text.rlike(r"[0-9]\.[0-9]")))
    out = out.withColumn("_card", find_spans(text, CARD, lambda m: _between(m, 13, 19), numbers))
    out = out.withColumn("_card", F.filter("_card", lambda x: luhn(x["m"])))
    out = out.withColumn("_phone", find_spans(text, PHONE, lambda m: _between(m, 9, 15), text.contains("+")))
    out = out.withColumn("_iban", find_spans(text, IBAN, None, text.rlike("[A-Z]{2}[0-9]{2}")))
    out = out.withColumn("_iban", F.filter("_iban", lambda x: mod97(x["m"])))
    out = out.withColumn("_ssn", find_spans(text, SSN, None, text.rlike("[0-9]-[0-9]")))

    def tagged(i: int, kind: str, of_text: Column) -> Column:
        score, more, less = CONTEXT[kind]

        def one(x: Column) -> Column:
            def scored(near: Column) -> Column:
                value = F.lit(score) + F.when(near.rlike(more), 0.3).otherwise(0.0) - F.when(near.rlike(less), 0.3).otherwise(0.0)
                return F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 2).alias("score"))

            near = F.concat(cut(of_text, F.greatest(x["s"] - BEFORE, F.lit(0)), x["s"]), F.lit(" | "), cut(of_text, x["e"], x["e"] + AFTER))
            return let(near, scored)

        return F.transform(F.col(f"_{kind}"), one)

    some = sum((F.size(f"_{k}") for k in KINDS[1:]), F.size("_email")) > 0
    every = let(pieces(text), lambda p: F.array_sort(F.concat(*[tagged(i, k, p) for i, k in enumerate(KINDS)])))
    every = F.when(some, every).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,kind:string,score:double>>"))
    kept = F.filter(every, lambda x: (x["k"] < 4) | (x["score"] >= LEAST))
    return out.withColumn("found", kept).select(*[c for c in docs.columns if c != "found"], "found")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, digest of the base spans, all spans, their scores."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["k"] < 4)
    scores = F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores")
    return find_personal(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores)
