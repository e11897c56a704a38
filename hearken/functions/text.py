"""Column builders for transcripts: tokens, normalisation, edit distance, common affixes, stable hashes.

White space and digits are those of Unicode. Null texts give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, also where use refers to it inside the lambda of an array function,
    which would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column | str) -> Column:
    """Words between white space; no words for an empty text."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def characters(text: Column | str) -> Column:
    """The text without white space; punctuation and case stay."""
    return F.regexp_replace(_col(text), r"(?U)\s", "")


def char_edits(reference: Column | str, hypothesis: Column | str) -> Column:
    return F.levenshtein(characters(reference), characters(hypothesis))


def word_edits(reference_words: Column | str, hypothesis_words: Column | str) -> Column:
    """Edit distance of two word arrays: each distinct word of the pair becomes one character, then strings compare.

    Pairs may have up to 20,000 distinct words."""
    a, b = _col(reference_words), _col(hypothesis_words)

    def encoded(side: Column, vocabulary: Column) -> Column:
        one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + F.array_position(vocabulary, w)), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(side, one), "")

    return bound(F.array_distinct(F.concat(a, b)), lambda v: F.levenshtein(encoded(a, v), encoded(b, v)))


def normalized(text: Column | str) -> Column:
    """Only digits, Latin letters and Hangul syllables."""
    return F.regexp_replace(_col(text), "[^0-9A-Za-z가-힣]", "")


def holds(normal: Column, value: Column | str) -> Column:
    """Containment of a value, once normalised, in a normalised text; what normalises to nothing is contained nowhere."""
    needle = normalized(value)
    return (needle != "") & F.contains(normal, needle)


def contains_normalized(text: Column | str, value: Column | str) -> Column:
    """Containment after normalisation of both."""
    return holds(normalized(text), value)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """How many code points two texts share at the start."""
    a, b = _col(a), _col(b)
    short = F.least(F.char_length(a), F.char_length(b))
    same = F.zip_with(F.split(F.substring(a, 1, 1 << 30), ""), F.split(F.substring(b, 1, 1 << 30), ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(short == 0, 0).otherwise(F.when(first == 0, short).otherwise(F.least(short, (first - 1).cast("int"))))


def common_suffix(a: Column | str, b: Column | str, prefix: Column) -> Column:
    """How many code points the texts share at the end, in what the prefix leaves."""
    rest = lambda x: F.reverse(F.substring(_col(x), prefix + 1, F.char_length(_col(x))))
    return common_prefix(rest(a), rest(b))


def stable_hash(text: Column | str) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def cleaned_tokens(text: Column | str) -> Column:
    """Word tokens reduced to digits, letters, Hangul, % and comma; empty ones are dropped."""
    kept = F.regexp_replace(_col(text), r"[^0-9A-Za-z가-힣%,\s\x85\p{Z}]+", "")
    return F.filter(F.split(kept, r"[\s\x85\p{Z}]+"), lambda w: w != "")


def first_distinct(spans: Column) -> Column:
    """An array without its repeats, first ones first."""
    return F.array_distinct(spans)


def two_decimals(value: Column | str) -> Column:
    """Fixed two decimals, empty for null."""
    return F.coalesce(F.format_string("%.2f", _col(value)), F.lit(""))
