"""Classification of word pairs by Hangul syllable structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.text import _col, common_prefix, common_suffix

CATEGORIES = ("same_surface", "vowel_shift", "coda_shift", "ending_or_particle_variant", "prefix_or_stem_variant", "contraction_or_expansion", "lexical_replacement")
FIRST, LAST, PER_INITIAL, PER_VOWEL = 0xAC00, 0xD7A3, 588, 28
LONGEST_TAIL = 4


def syllable(ch: Column) -> Column:
    """struct<initial, vowel, coda> of a Hangul syllable, null for any other character."""
    code = F.ascii(ch)
    at = code - FIRST
    parts = F.struct(F.floor(at / PER_INITIAL).cast("int").alias("initial"), F.floor((at % PER_INITIAL) / PER_VOWEL).cast("int").alias("vowel"), (at % PER_VOWEL).alias("coda"))
    return F.when(code.between(FIRST, LAST), parts)


def _shift(x: Column, y: Column) -> Column:
    a, b = syllable(x), syllable(y)
    vowel = (a["initial"] == b["initial"]) & (a["coda"] == b["coda"])
    coda = (a["initial"] == b["initial"]) & (a["vowel"] == b["vowel"])
    return F.when(x == y, "same").when(vowel, "vowel_shift").when(coda, "coda_shift").otherwise("none")


def shift_category(standard: Column | str, dialect: Column | str) -> Column:
    """vowel_shift or coda_shift where every differing syllable differs in that alone, else null."""
    a, b = _col(standard), _col(dialect)
    kinds = F.array_distinct(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), _shift), lambda k: k != "same"))
    return F.when((F.char_length(a) == F.char_length(b)) & (F.size(kinds) == 1) & (kinds[0] != "none"), kinds[0])


def pair_structure(standard: Column | str, dialect: Column | str) -> Column:
    """struct<prefix, suffix, standard_tail, dialect_tail>: shared affixes and what they leave."""
    a, b = _col(standard), _col(dialect)
    p = common_prefix(a, b)
    s = common_suffix(a, b, p)
    return F.struct(p.alias("prefix"), s.alias("suffix"), (F.char_length(a) - p - s).alias("standard_tail"), (F.char_length(b) - p - s).alias("dialect_tail"))


def classify_pair(standard: Column | str, dialect: Column | str) -> Column:
    """One of CATEGORIES. An empty side counts as contained in the other."""
    a, b = _col(standard), _col(dialect)
    shape, shift = pair_structure(a, b), shift_category(a, b)
    short = (shape["standard_tail"] <= LONGEST_TAIL) & (shape["dialect_tail"] <= LONGEST_TAIL)
    return (
        F.when(a == b, "same_surface")
        .when(shift.isNotNull(), shift)
        .when((shape["prefix"] >= 1) & short, "ending_or_particle_variant")
        .when((shape["suffix"] >= 1) & short, "prefix_or_stem_variant")
        .when(F.contains(a, b) | F.contains(b, a), "contraction_or_expansion")
        .otherwise("lexical_replacement")
    )


def signature(standard: Column | str, dialect: Column | str) -> Column:
    x = pair_structure(standard, dialect)
    return F.format_string("p%d:s%d:std%d:dia%d", x["prefix"], x["suffix"], x["standard_tail"], x["dialect_tail"])
