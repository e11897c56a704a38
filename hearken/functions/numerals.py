"""Sino-Korean and Arabic numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.text import _col

# Fixed values of the numeral system.
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
UNITS = {"십": 10, "백": 100, "천": 1000}
SCALES = {"만": 10**4, "억": 10**8, "조": 10**12}

_ARABIC = r"(?U)(\d[\d,]*)\s*([억만천])?"
_RUN = "[" + "".join([*DIGITS, *UNITS, *SCALES]) + "]+"
_MAGNITUDE = "[" + "".join([*UNITS, *SCALES]) + "]"


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in values.items() for x in kv])


def parse_sino(run: Column | str) -> Column:
    """The number that a run of numeral syllables spells; null where two digits stand side by side or another
    character occurs. The empty run is 0."""
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"), F.lit(False).alias("open"), F.lit(True).alias("sound"))

    def step(acc: Column, ch: Column) -> Column:
        digit, unit, scale = (F.element_at(_table(t), ch) for t in (DIGITS, UNITS, SCALES))
        one_at_least = lambda v: F.greatest(v, F.lit(1).cast("long"))
        make = lambda total, section, d, is_open, sound: F.struct(total.alias("total"), section.alias("section"), d.alias("digit"), is_open.alias("open"), sound.alias("sound"))
        no, yes = F.lit(False), F.lit(True)
        return (
            F.when(~acc["sound"] | (ch == ""), acc)
            .when(digit.isNotNull(), make(acc["total"], acc["section"], digit, yes, ~acc["open"]))
            .when(unit.isNotNull(), make(acc["total"], acc["section"] + one_at_least(acc["digit"]) * unit, zero, no, yes))
            .when(scale.isNotNull(), make(acc["total"] + one_at_least(acc["section"] + acc["digit"]) * scale, zero, zero, no, yes))
            .otherwise(make(zero, zero, zero, no, no))
        )

    return F.aggregate(F.split(_col(run), ""), begin, step, lambda a: F.when(a["sound"], a["total"] + a["section"] + a["digit"]))


def numeric_values(text: Column | str) -> Column:
    """The set of numbers in a text: Arabic groups times the scale after them, then, in what is left, numeral runs that
    hold a unit or scale. Numbers beyond 64 bits are left out."""
    t = _col(text)
    groups = F.arrays_zip(F.regexp_extract_all(t, F.lit(_ARABIC), F.lit(1)).alias("d"), F.regexp_extract_all(t, F.lit(_ARABIC), F.lit(2)).alias("s"))
    scale = _table(SCALES | {"천": 1000})
    arabic = F.transform(groups, lambda g: F.try_multiply(F.replace(g["d"], F.lit(","), F.lit("")).try_cast("long"), F.coalesce(F.element_at(scale, g["s"]), F.lit(1).cast("long"))))
    runs = F.regexp_extract_all(F.regexp_replace(t, _ARABIC, " "), F.lit(_RUN), F.lit(0))
    spoken = F.filter(F.transform(F.filter(runs, lambda r: r.rlike(_MAGNITUDE)), parse_sino), lambda v: v > 0)
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(arabic, spoken))))
