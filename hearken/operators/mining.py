"""Mining of business-critical spans, by substring and by word boundary; domain, intent and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.text import _col, bound, cleaned_tokens

# Cue words, patterns and names of the annotation scheme.
RISK = {"negation": "high", "amount": "high", "date_time": "high", "entity": "medium", "intent_cue": "high", "confirmation": "high", "other": "medium"}
AMOUNT = r"[0-9일이삼사오육칠팔구십백천만억]+ ?(?:원|만원|천원|프로|%)"
DATE_TIME = r"(?:오늘|내일|모레|어제|오전|오후|다음 ?주|이번 ?주|[0-9]+월|[0-9]+일|[0-9]+시|[0-9]+분)"
CUES = (
    ("negation", ("안", "못", "없", "아니", "불가")),
    ("intent_cue", ("가입", "결제", "문의", "배송", "변경", "예약", "요금", "취소", "환불", "해지")),
    ("confirmation", ("네", "예", "맞", "아니", "그렇")),
)
DOMAINS = (
    ("cancellation", ("해지", "취소")),
    ("billing", ("결제", "요금", "납부", "환불", "원")),
    ("delivery", ("배송", "택배")),
    ("reservation", ("예약", "일정")),
    ("plan_change", ("변경", "가입", "요금제")),
    ("complaint", ("불만", "민원", "항의")),
    ("technical_support", ("오류", "고장", "안되", "인터넷")),
)
INTENTS = {
    "cancellation": "handle_cancellation",
    "billing": "handle_billing_or_refund",
    "delivery": "handle_delivery_status",
    "reservation": "handle_reservation",
    "plan_change": "handle_plan_change",
    "complaint": "handle_complaint",
    "technical_support": "handle_technical_support",
    "other": "other_aicc_intent",
}
BOUNDARY_RULES = (
    ("negation", "exact", ("안", "못")),
    ("negation", "prefix", ("없", "아니", "불가")),
    ("intent_cue", "prefix", ("가입", "결제", "문의", "배송", "변경", "예약", "요금", "취소", "환불", "해지")),
    ("confirmation", "exact", ("네", "예")),
    ("confirmation", "prefix", ("아니", "맞", "그렇")),
)
DATE_WORDS = ("오늘", "내일", "모레", "어제", "오전", "오후")
SLOT_CATEGORIES = ("amount", "date_time", "intent_cue", "confirmation", "entity")
_NUMERALS = "[0-9,일이삼사오육칠팔구십백천만억]+"
_UNIT = "(?:원|만원|천원|프로|%)"

SPANS = "array<struct<span_text:string,category:string>>"


def _span(text: Column, category: str) -> Column:
    return F.struct(text.alias("span_text"), F.lit(category).alias("category"))


def substring_spans(text: Column | str, *, amount: str = AMOUNT, date_time: str = DATE_TIME, cues: tuple = CUES) -> Column:
    """All matches of the amount pattern, then of the date pattern, then one span for each cue that the text contains."""
    t = _col(text)
    parts = [_matches(t, amount, "amount"), _matches(t, date_time, "date_time")]
    hits = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(cue)), _span(F.lit(cue), name)) for name, group in cues for cue in group]))
    return F.concat(*parts, hits).cast(SPANS)


def _matches(t: Column, pattern: str, category: str) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: _span(m, category))


def boundary_spans(text: Column | str, *, rules: tuple = BOUNDARY_RULES, date_words: tuple = DATE_WORDS) -> Column:
    """Spans that open a token, in order amounts, dates, cues (each by token, then rule), without repeats.

    An amount is a numeral run with its unit in one token, or a token that is all numerals before one that opens with a
    unit. `exact` cues are whole tokens, `prefix` cues open one."""

    def amount(token: Column, following: Column) -> Column:
        inline = F.regexp_extract(token, f"^{_NUMERALS}\\s?{_UNIT}", 0)
        after = F.regexp_extract(F.coalesce(following, F.lit("")), f"^{_UNIT}", 0)
        return F.when(inline != "", _span(inline, "amount")).when(token.rlike(f"^{_NUMERALS}$") & (after != ""), _span(F.concat_ws(" ", token, after), "amount"))

    def dates(token: Column) -> Column:
        number = F.regexp_extract(token, "^(?:[0-9]+월|[0-9]+일|[0-9]+시|[0-9]+분)", 0)
        return F.array(*[F.when(F.startswith(token, F.lit(w)), _span(F.lit(w), "date_time")) for w in date_words], F.when(number != "", _span(number, "date_time")))

    def cues(token: Column) -> Column:
        return F.array(*[F.when(token == cue if mode == "exact" else F.startswith(token, F.lit(cue)), _span(F.lit(cue), name)) for name, mode, group in rules for cue in group])

    # one cheap test for each token; the few that pass are looked at rule by rule
    opens = lambda words: "^(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"
    dated, cued = opens(date_words)[:-1] + "|[0-9])", opens([cue for _, _, group in rules for cue in group])

    def found(tokens: Column) -> Column:
        amounts = F.transform(tokens, lambda token, i: F.when(token.rlike(f"^{_NUMERALS}"), amount(token, F.get(tokens, i + 1))))
        some = lambda pattern, each: F.flatten(F.transform(F.filter(tokens, lambda t: t.rlike(pattern)), each))
        return F.concat(amounts, some(dated, dates), some(cued, cues))

    return F.array_distinct(F.array_compact(bound(cleaned_tokens(text), found))).cast(SPANS)


def hints(text: Column | str) -> Column:
    """Names of the categories that a text hints at, in order; `other` where there is none."""
    t = _col(text)
    has = lambda group: F.lit(False) if not group else _any(t, group)
    by = dict(CUES)
    found = F.array_compact(F.array(F.when(has(by["negation"]), "negation"), F.when(t.rlike(AMOUNT), "amount"), F.when(t.rlike(DATE_TIME), "date_time"), F.when(has(by["intent_cue"]), "intent_cue"), F.when(has(by["confirmation"]), "confirmation")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def _any(t: Column, cues: tuple) -> Column:
    out = F.contains(t, F.lit(cues[0]))
    for c in cues[1:]:
        out = out | F.contains(t, F.lit(c))
    return out


def domain(text: Column | str, domains: tuple = DOMAINS) -> Column:
    """The first domain of which a cue occurs in the text, else `other`."""
    t, out = _col(text), None
    for name, cues in domains:
        out = F.when(_any(t, cues), name) if out is None else out.when(_any(t, cues), name)
    return out.otherwise("other")


def intent(domain_name: Column, intents: dict = INTENTS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in intents.items() for x in kv]), domain_name)


def with_risk(spans: Column) -> Column:
    """Spans with their business risk and what recognition must preserve."""
    risk = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    return F.transform(spans, lambda s: F.struct(s["span_text"].alias("span_text"), s["category"].alias("category"), F.element_at(risk, s["category"]).alias("business_risk"), F.format_string("preserve %s meaning", s["category"]).alias("expected_asr_preservation")))


def slots(spans: Column) -> Column:
    """Spans of slot categories as struct<name, value, span_text>."""
    kept = F.filter(spans, lambda s: s["category"].isin(*SLOT_CATEGORIES))
    return F.transform(kept, lambda s: F.struct(s["category"].alias("name"), s["span_text"].alias("value"), s["span_text"].alias("span_text")))


def merged_spans(standard: Column | str, dialect: Column | str, candidate_hints: Column) -> Column:
    """Substring spans of both transcripts in one text, after the hinted candidates (struct<span_text, category>) that are not
    `other`, without repeats."""
    both = F.concat_ws(" ", _col(standard), _col(dialect))
    return F.array_distinct(F.concat(F.filter(candidate_hints, lambda s: s["category"] != "other"), substring_spans(both)))
