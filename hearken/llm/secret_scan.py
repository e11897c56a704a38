"""Secret scan by multipart credential linking.

Strong parts (assigned secrets, access identifiers, long hex strings) are always reported. Weak candidates are
reported only where complementary parts lie in the same scope, a window of SCOPE code points between the nearer ends:
an account identifier next to a secret, a random-looking token next to an identifier, an endpoint next to both. The
join of the parts is an interval join inside each document, over its sorted spans: one pass in either direction finds the
nearest identifier and the nearest secret of each part, and no rows are shuffled. Every weak span that is reported comes
with the parts that it was linked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.spans import find_spans, joined, masked, nearest

KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
SCOPE = 240

_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_HEAD = "^" + _KEY + r"""["']?\x20*[:=]\x20*["']?"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
IDENT = r"""(?i:\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
ENDPOINT = r"(?:https?|ftp|amqps?|postgres(?:ql)?|mysql|redis|mongodb)://[A-Za-z0-9.:@_-]+(?:/[A-Za-z0-9._~/?=&%-]*)?"


PART = "struct<s:int,e:int,k:int>"


def _parts(*kinds: str) -> Column:
    """The spans of these kinds, by start; k is the place of the kind."""
    tagged = lambda k: F.transform(F.col(f"_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(k)).alias("k")))
    return F.array_sort(F.concat(*map(tagged, kinds)))


def _of(*kinds: str):
    return lambda x: x["k"].isin(*map(KINDS.index, kinds))


def _partner(x: Column, i: int) -> Column:
    """The nearest part of a set within the scope, or null; x: as nearest() has it."""
    own, before, after = x["x"], x["before"][f"m{i}"], x["after"][f"m{i}"]
    gap = lambda p: F.when(p.isNull(), 1 << 30).otherwise(F.greatest(F.lit(0), own["s"] - p["e"], p["s"] - own["e"]))
    back, ahead = gap(before), gap(after)
    return F.when(F.least(back, ahead) <= SCOPE, F.when(back <= ahead, before).otherwise(after))


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with `found`: array<struct<s, k, e, kind, name, value>> sorted by start, then kind as in KINDS; k is its place there,
    name and value are the nearest identifier and secret that a weak span was linked to, null for others.

    Null texts count as empty, and give an empty array. The base kinds are exact; links add spans and remove none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.char_length(F.regexp_replace(m, _ASSIGN_HEAD, ""))
    out = docs.withColumn("_assign", find_spans(text, ASSIGN, None, text.rlike(ASSIGN)))
    out = out.withColumn("_assign", F.filter("_assign", lambda x: value(x["m"]) >= 6))
    out = out.withColumn("_access", find_spans(text, ACCESS, None, text.contains("AKIA")))
    out = out.withColumn("_hex", find_spans(text, HEX, None, text.rlike(HEX)))
    out = out.withColumn("_ident", find_spans(text, IDENT, None, text.rlike(IDENT)))
    named = (F.size("_ident") > 0) | (F.size("_access") > 0)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    out = out.withColumn("_token", find_spans(text, TOKEN, mixed, named))
    # tokens that lie in or over a strong span are that span
    apart = nearest(_parts("assign", "access", "hex", "token"), PART, _of("assign", "access", "hex"))
    overlaps = lambda x: F.coalesce(x["before"]["m0"]["e"] > x["x"]["s"], F.lit(False)) | F.coalesce(x["after"]["m0"]["s"] < x["x"]["e"], F.lit(False))
    free = F.transform(F.filter(apart, lambda x: (x["x"]["k"] == KINDS.index("token")) & ~overlaps(x)), lambda x: F.struct(x["x"]["s"].alias("s"), x["x"]["e"].alias("e"), F.lit("").alias("m")))
    out = out.withColumn("_token", F.when(F.size("_token") > 0, free).otherwise(F.col("_token")))
    values = F.size("_assign") + F.size("_hex") + F.size("_token") > 0
    out = out.withColumn("_endpoint", find_spans(text, ENDPOINT, None, named & values & text.contains("://")))
    linked = nearest(_parts(*KINDS), PART, _of("access", "ident"), _of("assign", "hex", "token"))
    needs_name, needs_value = ("token", "endpoint"), ("ident", "endpoint")

    def judged(x: Column) -> Column:
        k, weak_name, weak_value = x["x"]["k"], _of(*needs_name)(x["x"]), _of(*needs_value)(x["x"])
        name, value = F.when(weak_name, _partner(x, 0)), F.when(weak_value, _partner(x, 1))
        kind = F.get(F.array(*map(F.lit, KINDS)), k)
        wanted = (~weak_name | name.isNotNull()) & (~weak_value | value.isNotNull())
        return F.struct(x["x"]["s"].alias("s"), k.alias("k"), x["x"]["e"].alias("e"), kind.alias("kind"), name.alias("name"), value.alias("value"), wanted.alias("wanted"))

    bare = F.transform(_parts("assign", "access", "hex"), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.get(F.array(*map(F.lit, KINDS)), x["k"]).alias("kind"), *[F.lit(None).cast("struct<s:int,e:int>").alias(c) for c in ("name", "value")], F.lit(True).alias("wanted")))
    weak = F.size("_ident") + F.size("_token") + F.size("_endpoint") > 0
    found = F.filter(F.when(weak, F.transform(linked, judged)).otherwise(bare), lambda x: x["wanted"])
    found = F.array_sort(F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "kind", "name", "value")])))
    return out.withColumn("found", found).select(*[c for c in docs.columns if c != "found"], "found")


def links_of(found: Column) -> Column:
    """kind:start:end>start:end of every reported weak span and each part that it was linked to, comma-joined."""
    one = lambda x, c: F.when(x[c].isNotNull(), F.concat(F.concat_ws(":", x["kind"], x["s"], x["e"]), F.lit(">"), F.concat_ws(":", x[c]["s"], x[c]["e"])))
    return F.array_join(F.flatten(F.transform(found, lambda x: F.array_compact(F.array(one(x, "name"), one(x, "value"))))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, digest of the base spans, all spans, links of the weak ones."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["k"] < 3)
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), links_of(F.col("found")).alias("links"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported span; documents stay, and n_chars, where there is one, follows the text. Documents without one are unchanged."""
    masked_text = F.when(F.size("found") > 0, masked(F.col("text"), F.col("found"), "[SECRET]")).otherwise(F.col("text"))
    out = find_secrets(docs).withColumn("text", masked_text)
    if "n_chars" in docs.columns:
        length = F.when(F.size("found") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
