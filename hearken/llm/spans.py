"""Spans of regular expressions in a text as built-in column expressions.

A span is struct<s, e, m>: start and end in code points (end exclusive) and the matched text. The matches are those of
a leftmost, non-overlapping search. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


#: Code points of a piece of a text, for cuts from the middle of long texts.
PIECE = 512


def no_spans() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold after each item, as an array of this kind.

    The items go through in chunks of about the square root of their number, so that the growing arrays copy no more than
    the number to the power of 1.5."""

    def of(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x).cast("double"))), F.lit(1)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / width).cast("int")), lambda k: F.slice(x, k * width + 1, width))

        def one(acc: Column, item: Column) -> Column:
            return let(step(acc["last"], item), lambda v: F.struct(v.alias("last"), F.concat(acc["out"], F.array(v)).alias("out")))

        def many(acc: Column, chunk: Column) -> Column:
            begin = F.struct(acc["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
            return let(F.aggregate(chunk, begin, one), lambda r: F.struct(r["last"].alias("last"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        begin = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(chunks, begin, many, lambda acc: acc["out"]))

    return let(items, of)


def find_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, gate: Column | None = None) -> Column:
    """All matches; keep tests the matched text, gate is a cheap test without which a text has none.

    The lengths of what stands between the matches (split) and of the matches themselves add up to the positions.
    """
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    zipped = F.arrays_zip(between.alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    zipped = F.transform(zipped, lambda x: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.coalesce(F.char_length(x["m"]), F.lit(0)).alias("n")))

    def placed(x: Column) -> Column:
        ends = scan(x, F.lit(0), "int", lambda at, one: at + one["b"] + one["n"])
        return let(ends, lambda e: F.transform(x, lambda one, i: F.struct((F.get(e, i) - one["n"]).alias("s"), F.get(e, i).alias("e"), one["m"].alias("m"))))

    wanted = lambda x: x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["m"])
    gate = text.isNotNull() if gate is None else gate
    return F.coalesce(F.when(gate, F.filter(let(zipped, placed), wanted)), no_spans())


def pieces(text: Column) -> Column:
    """A text as an array of pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(of: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text in pieces; what lies beyond its end is left out."""
    first = F.floor(a / PIECE).cast("int")
    some = F.slice(of, first + 1, F.floor(b / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)


def nearest(items: Column, kind: str, *members: Callable[[Column], Column]) -> Column:
    """array<struct<x, before, after>> of spans sorted by start: for each item x and each set of members the member of the
    largest end among those up to x, and the one of the smallest start among those from x on, as struct<s, e>; null if none."""
    none = F.lit(None).cast("struct<s:int,e:int>")
    begin = F.struct(*[none.alias(f"m{i}") for i in range(len(members))])
    state = "struct<" + ",".join(f"m{i}:struct<s:int,e:int>" for i in range(len(members))) + ">"

    def step(better: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def one(acc: Column, x: Column) -> Column:
            own = F.struct(x["s"].alias("s"), x["e"].alias("e"))
            return F.struct(*[F.when(test(x) & (acc[f"m{i}"].isNull() | better(x, acc[f"m{i}"])), own).otherwise(acc[f"m{i}"]).alias(f"m{i}") for i, test in enumerate(members)])

        return one

    def of(x: Column) -> Column:
        before = scan(x, begin, state, step(lambda new, old: new["e"] > old["e"]))
        after = F.reverse(scan(F.reverse(x), begin, state, step(lambda new, old: new["s"] <= old["s"])))
        both = F.struct(before.alias("b"), after.alias("a"))
        return let(both, lambda n: F.transform(x, lambda one, i: F.struct(one.alias("x"), F.get(n["b"], i).alias("before"), F.get(n["a"], i).alias("after"))))

    return F.when(F.size(items) > 0, let(items, of)).otherwise(F.array().cast(f"array<struct<x:{kind},before:{state},after:{state}>>"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a match pass the Luhn checksum."""
    values = F.transform(F.reverse(F.split(digits_of(m), "")), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 checksum (remainder 1)."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans with a field kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping spans replaced by the mask; spans are sorted by start."""

    def of(b: Column) -> Column:
        ends, x, of_text = b["ends"], b["x"], b["text"]
        upto = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        out = F.transform(x, lambda one, i: F.when(one["s"] >= upto(i), F.concat(cut(of_text, upto(i), one["s"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(out, ""), cut(of_text, F.element_at(ends, -1), F.char_length(text)))

    ends = scan(spans, F.lit(0), "int", lambda at, one: F.greatest(at, one["e"]))
    return F.when(F.size(spans) > 0, let(F.struct(ends.alias("ends"), spans.alias("x"), pieces(text).alias("text")), of)).otherwise(text)
