"""Queries over the driver's tables, each with its SQL: the engine's operators on analogue data.

A turn of a conversation is a reference and the next turn its hypothesis. DuckDB's levenshtein counts bytes, so the SQL writes
each element of two sequences as one byte: those that both have by their number, the others by one byte for either side.
Korean logic runs over literal rows. Floats are rounded to 9 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import hangul, numerals, text
from hearken.operators import cohorts, keyed, mining, review, sampling, scoring, stats, validate
from hearken.plans import workflows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r9(c):
    return F.round(c, 9)


# ---- turns ------------------------------------------------------------------------------------------------------

_TURNS = "turns AS (SELECT a.conv_id, a.turn, a.role, a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").filter("text is not null")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("ref")).join(after, ["conv_id", "turn"])


def _edits(a: str, b: str) -> str:
    """The edit distance of two lists that have at most 125 different elements in common; an error for more."""
    of = lambda x, own: f"array_to_string(list_transform({x}, lambda w: chr(coalesce(nullif(list_position(v, w), 0) + 2, {own})::INT)), '')"
    return f"CASE WHEN len(v) > 125 THEN error('too many elements in common') ELSE levenshtein({of(a, 1)}, {of(b, 2)}) END"


@query(
    f"WITH {_TURNS}, c AS (SELECT role, string_split(regexp_replace(ref, '\\s', '', 'g'), '') AS a, string_split(regexp_replace(hyp, '\\s', '', 'g'), '') AS b FROM turns), v AS (SELECT *, list_intersect(a, b) AS v FROM c), e AS (SELECT role, len(a) AS n, {_edits('a', 'b')} AS e FROM v)"
    " SELECT role, count(*) AS turns, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS chars, round(coalesce(sum(e) / nullif(sum(n), 0), 0)::DOUBLE, 9) AS cer FROM e GROUP BY role"
)
def q01_turn_error_rates(spark, sf_dir):
    t = _turns(spark, sf_dir).select("role", text.char_edits("ref", "hyp").alias("e"), F.char_length(text.characters("ref")).alias("n"))
    rate = F.coalesce(F.try_divide(F.sum("e"), F.sum("n")), F.lit(0.0))
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum("e").cast("long").alias("edits"), F.sum("n").cast("long").alias("chars"), _r9(rate).alias("cer"))


@query(
    f"WITH {_TURNS}, w AS (SELECT role, {_WORDS.format('ref')} AS a, {_WORDS.format('hyp')} AS b FROM turns), v AS (SELECT *, list_intersect(a, b) AS v FROM w)"
    f" SELECT role, sum({_edits('a', 'b')})::BIGINT AS word_edits, sum(len(a))::BIGINT AS words FROM v GROUP BY role"
)
def q02_word_error_rates(spark, sf_dir):
    """Word edit distance over all words."""
    t = _turns(spark, sf_dir).select("role", text.words("ref").alias("a"), text.words("hyp").alias("b"))
    return t.groupBy("role").agg(F.sum(text.word_edits("a", "b")).cast("long").alias("word_edits"), F.sum(F.size("a")).cast("long").alias("words"))


@query(
    f"WITH {_TURNS}, w AS (SELECT role, list_distinct({_WORDS.format('ref')}) AS g, list_distinct({_WORDS.format('hyp')}) AS p FROM turns),"
    " s AS (SELECT role, sum(len(list_intersect(p, g)))::BIGINT AS tp, sum(len(p))::BIGINT AS np, sum(len(g))::BIGINT AS ng FROM w GROUP BY role)"
    " SELECT role, tp, np - tp AS fp, ng - tp AS fn, round(coalesce(tp / nullif(np, 0), 0)::DOUBLE, 9) AS slot_precision, round(coalesce(tp / nullif(ng, 0), 0)::DOUBLE, 9) AS slot_recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0)::DOUBLE, 9) AS f1 FROM s"
)
def q03_slot_f1(spark, sf_dir):
    t = _turns(spark, sf_dir).select("role", F.array_distinct(text.words("ref")).alias("g"), F.array_distinct(text.words("hyp")).alias("p"))
    n = lambda c: F.sum(F.size(c).cast("long"))
    t = t.groupBy("role").agg(n(F.array_intersect("p", "g")).alias("tp"), n(F.array_except("p", "g")).alias("fp"), n(F.array_except("g", "p")).alias("fn"))
    rate = lambda a, b: _r9(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select("role", "tp", "fp", "fn", rate(tp, tp + fp).alias("slot_precision"), rate(tp, tp + fn).alias("slot_recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


# ---- cohorts ----------------------------------------------------------------------------------------------------

def _core(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    names = [r["n_name"] for r in n.orderBy("n_nationkey").limit(5).collect()]  # five rows
    return n, names


@query(
    "WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), f AS (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5), core AS (SELECT n_name AS core FROM nation ORDER BY n_nationkey LIMIT 1),"
    " s AS (SELECT s_suppkey, a.n_name AS b, coalesce(p.n_name, '') AS p, coalesce(c.n_name, '') AS c, core FROM supplier JOIN n a ON a.k = s_nationkey LEFT JOIN n p ON p.k = s_suppkey % 7 LEFT JOIN n c ON c.k = s_suppkey % 3 CROSS JOIN core),"
    " l AS (SELECT s_suppkey, CASE WHEN b = core AND p = core AND c = core THEN 'busan_strict' WHEN p = core OR c = core THEN 'busan_residence' WHEN b = core THEN 'busan_any' WHEN b IN (SELECT n_name FROM f) OR p IN (SELECT n_name FROM f) OR c IN (SELECT n_name FROM f) THEN 'gyeongsang_other' ELSE 'other' END AS slice_label FROM s)"
    " SELECT slice_label, CASE WHEN slice_label LIKE 'busan%' THEN 'busan' ELSE slice_label END AS cohort, count(*) AS n FROM l GROUP BY ALL"
)
def q04_slices_and_cohorts(spark, sf_dir):
    n, names = _core(spark, sf_dir)
    pick = lambda k, name: F.broadcast(n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name)))  # noqa: E731  nation has 25 rows by definition
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7).cast("int").alias("k2"), (F.col("s_suppkey") % 3).cast("int").alias("k3"))
    s = s.join(pick("s_nationkey", "b"), "s_nationkey").join(pick("k2", "p"), "k2", "left").join(pick("k3", "c"), "k3", "left")
    s = s.select(cohorts.slice_label("b", "p", "c", core=names[0], regions=tuple(names)).alias("slice_label"))
    return s.groupBy("slice_label", cohorts.cohort("slice_label").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 4 AS bucket, grouping(event_type, user_id % 4) AS grain, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((), (event_type), (event_type, user_id % 4))")
def q05_multi_grain_counts(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("bucket"), "value")
    sets = [[], [F.col("event_type")], [F.col("event_type"), F.col("bucket")]]
    return e.groupingSets(sets, "event_type", "bucket").agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", "bucket", "grain", "n", "total")


_PAIRS = (
    ("가", "가", "same_surface", "p1:s0:std0:dia0"),
    ("바꿔도", "바까도", "vowel_shift", "p1:s1:std1:dia1"),
    ("각", "간", "coda_shift", "p0:s0:std1:dia1"),
    ("각나", "간너", "lexical_replacement", "p0:s0:std2:dia2"),
    ("맞나요", "맞나", "ending_or_particle_variant", "p2:s0:std1:dia0"),
    ("그래서", "이래서", "prefix_or_stem_variant", "p0:s2:std1:dia1"),
    ("가나", "가나다라마바사", "contraction_or_expansion", "p2:s0:std0:dia5"),
    ("나", "가나다", "contraction_or_expansion", "p0:s0:std1:dia3"),
    ("", "가", "contraction_or_expansion", "p0:s0:std0:dia1"),
    ("했나요", "캤나", "lexical_replacement", "p0:s0:std3:dia2"),
)


def _values(rows) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(_PAIRS)}) t(standard, dialect, category, signature)")
def q06_pair_classes(spark, sf_dir):
    rows = spark.createDataFrame([p[:2] for p in _PAIRS], "standard string, dialect string")
    return rows.select("standard", "dialect", hangul.classify_pair("standard", "dialect").alias("category"), hangul.signature("standard", "dialect").alias("signature"))


_LCP = "list_aggregate(list_transform(range(1, least(length(a), length(b)) + 1), lambda k: CASE WHEN left(a, k) = left(b, k) THEN k ELSE 0 END), 'max')"


@query(
    "WITH p AS (SELECT DISTINCT p_type AS a, p_brand || ' ' || split_part(p_type, ' ', 1) AS b FROM part),"
    f" q AS (SELECT a, b, coalesce({_LCP}, 0) AS p FROM p),"
    " r AS (SELECT a, b, p, coalesce(list_aggregate(list_transform(range(1, least(length(a), length(b)) - p + 1), lambda k: CASE WHEN right(a, k) = right(b, k) THEN k ELSE 0 END), 'max'), 0) AS s FROM q)"
    " SELECT a, b, CASE WHEN a = b THEN 'same_surface' WHEN p >= 1 AND length(a) - p - s <= 4 AND length(b) - p - s <= 4 THEN 'ending_or_particle_variant' WHEN s >= 1 AND length(a) - p - s <= 4 AND length(b) - p - s <= 4 THEN 'prefix_or_stem_variant' WHEN contains(a, b) OR contains(b, a) THEN 'contraction_or_expansion' ELSE 'lexical_replacement' END AS category,"
    " 'p' || p || ':s' || s || ':std' || (length(a) - p - s) || ':dia' || (length(b) - p - s) AS signature FROM r"
)
def q07_pair_structure(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_type").alias("a"), F.concat_ws(" ", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1))).alias("b")).distinct()
    return p.select("a", "b", hangul.classify_pair("a", "b").alias("category"), hangul.signature("a", "b").alias("signature"))


@query(
    "WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> ''), 1) AS p FROM documents),"
    " c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM w GROUP BY ALL)"
    " SELECT doc_id, w AS primary_word FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1"
)
def q08_primary_label(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    return sampling.primary_label(d, ["doc_id"], "w", "primary_word")


# ---- outcomes and clusters ---------------------------------------------------------------------------------------

_NORM = "regexp_replace({}, '[^0-9A-Za-z가-힣]', '', 'g')"
_UNITS = (
    f"{_TURNS}, u AS (SELECT conv_id * 1000 + turn AS review_id, role AS cohort, unnest({_WORDS.format('ref')}) AS w, {_NORM.format('hyp')} AS h FROM turns),"
    f" o AS (SELECT review_id, cohort, length(w) >= 8 AS dialect, NOT ({_NORM.format('w')} <> '' AND contains(h, {_NORM.format('w')})) AS lost FROM u),"
    " k AS (SELECT review_id, cohort, count(*) FILTER (dialect) AS dt, count(*) FILTER (dialect AND lost) AS de, count(*) FILTER (NOT dialect) AS pt, count(*) FILTER (NOT dialect AND lost) AS pe FROM o GROUP BY ALL)"
)


def _clusters(spark, sf_dir) -> DataFrame:
    """Turns as utterances: words of 8 characters or more are the marked units, the others plain."""
    t = _turns(spark, sf_dir).withColumn("w", text.words("ref"))
    unit = lambda w: F.struct(w.alias("dialect"), w.alias("standard"))
    t = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
        F.col("role").alias("cohort"),
        F.col("hyp").alias("hypothesis"),
        F.transform(F.filter("w", lambda w: F.char_length(w) >= 8), unit).alias("dialect_units"),
        F.transform(F.filter("w", lambda w: F.char_length(w) < 8), unit).alias("plain_units"),
    )
    return scoring.clusters(t).filter("dialect_total + plain_total > 0")


@query(f"WITH {_UNITS} SELECT review_id, cohort, dt AS dialect_total, de AS dialect_error, pt AS plain_total, pe AS plain_error FROM k")
def q09_clusters(spark, sf_dir):
    wide = _clusters(spark, sf_dir)
    return wide.select("review_id", "cohort", *[F.col(c).cast("long").alias(c) for c in ("dialect_total", "dialect_error", "plain_total", "plain_error")])


_SUMS = "t AS (SELECT cohort, sum(dt)::DOUBLE AS dt, sum(de)::DOUBLE AS de, sum(pt)::DOUBLE AS pt, sum(pe)::DOUBLE AS pe FROM k GROUP BY cohort)"


@query(
    f"WITH {_UNITS}, {_SUMS} SELECT cohort, round(de / nullif(dt, 0), 9) AS dialect_rate, round(pe / nullif(pt, 0), 9) AS plain_rate, round(de / nullif(dt, 0) - pe / nullif(pt, 0), 9) AS difference,"
    " round((de / nullif(dt, 0)) / nullif(pe / nullif(pt, 0), 0), 9) AS ratio, round(de * (pt - pe) / nullif(pe * (dt - de), 0), 9) AS odds_ratio FROM t"
)
def q10_rates(spark, sf_dir):
    return stats.rates(_clusters(spark, sf_dir), "cohort").select("cohort", *[_r9(F.col(c)).alias(c) for c in ("dialect_rate", "plain_rate", "difference", "ratio", "odds_ratio")])


@query(
    f"WITH {_UNITS}, {_SUMS}, s AS (SELECT cohort, de / dt - pe / pt AS d, sqrt((de + pe) / (dt + pt) * (1 - (de + pe) / (dt + pt)) * (1 / dt + 1 / pt)) AS se FROM t WHERE dt > 0 AND pt > 0)"
    " SELECT cohort, round(se, 9) AS naive_se, round(d / nullif(se, 0), 9) AS z FROM s"
)
def q11_two_proportion_z(spark, sf_dir):
    out = stats.two_proportion(_clusters(spark, sf_dir), "cohort").filter("naive_se is not null")
    return out.select("cohort", _r9(F.col("naive_se")).alias("naive_se"), _r9(F.col("z")).alias("z"))


@query(
    f"WITH {_UNITS}, {_SUMS}, e AS (SELECT cohort, de * (pt - pe) / nullif(pe * (dt - de), 0) AS o, least(de, dt - de, pe, pt - pe) > 0 AS f, sqrt(1 / nullif(de, 0) + 1 / nullif(dt - de, 0) + 1 / nullif(pe, 0) + 1 / nullif(pt - pe, 0)) AS se FROM t)"
    " SELECT cohort, round(coalesce(o, 0), 9) AS odds_ratio, round(CASE WHEN f THEN exp(ln(o) - 1.96 * se) ELSE 0 END, 9) AS lower, round(CASE WHEN f THEN exp(ln(o) + 1.96 * se) ELSE 0 END, 9) AS upper FROM e"
)
def q12_wald_interval(spark, sf_dir):
    return stats.wald_interval(_clusters(spark, sf_dir), "cohort").select("cohort", *[_r9(F.col(c)).alias(c) for c in ("odds_ratio", "lower", "upper")])


@query(
    f"WITH {_UNITS}, x AS (SELECT cohort, de * (pt - pe) / (dt + pt)::DOUBLE AS r, (dt - de) * pe / (dt + pt)::DOUBLE AS s, (de + pt - pe) / (dt + pt)::DOUBLE AS p, (dt - de + pe) / (dt + pt)::DOUBLE AS q FROM k),"
    " m AS (SELECT cohort, sum(r) AS r, sum(s) AS s, sum(p * r) AS pr, sum(p * s + q * r) AS c, sum(q * s) AS qs FROM x GROUP BY cohort)"
    " SELECT cohort, round(CASE WHEN r > 0 AND s > 0 THEN r / s END, 9) AS mh_odds_ratio, round(CASE WHEN r > 0 AND s > 0 THEN sqrt(pr / (2 * r * r) + c / (2 * r * s) + qs / (2 * s * s)) END, 9) AS mh_log_se FROM m"
)
def q13_mantel_haenszel(spark, sf_dir):
    return stats.mantel_haenszel(_clusters(spark, sf_dir), "cohort").select("cohort", _r9(F.col("mh_odds_ratio")).alias("mh_odds_ratio"), _r9(F.col("mh_log_se")).alias("mh_log_se"))


@query(
    f"WITH {_UNITS}, x AS (SELECT cohort, dt, pt, de, de + pe AS e, dt + pt AS n FROM k),"
    " m AS (SELECT cohort, sum(dt * e / n::DOUBLE) AS mean, sum(CASE WHEN n > 1 THEN dt * (e / n::DOUBLE) * (1 - e / n::DOUBLE) * (n - dt) / (n - 1)::DOUBLE ELSE 0 END) AS v, sum(e)::DOUBLE AS e, sum(dt)::DOUBLE AS k, sum(pt)::DOUBLE AS m, count(*) FILTER (dt > 0 AND pt > 0 AND e > 0 AND e < n) AS informative FROM x GROUP BY cohort)"
    " SELECT cohort, informative, round(mean / nullif(k, 0) - (e - mean) / nullif(m, 0), 9) AS null_mean, round(sqrt(v) * (1 / nullif(k, 0) + 1 / nullif(m, 0)), 9) AS null_sd FROM m"
)
def q14_permutation_null(spark, sf_dir):
    return stats.permutation_null(_clusters(spark, sf_dir), "cohort").select("cohort", "informative", _r9(F.col("null_mean")).alias("null_mean"), _r9(F.col("null_sd")).alias("null_sd"))


@query(
    f"WITH {_UNITS}, i AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS i, count(*) OVER () AS n FROM k),"
    " d AS (SELECT d.range AS draw, s.i AS slot, ('0x' || substr(md5('bootstrap-' || d.range || '-' || s.i), 1, 15))::BIGINT % s.n AS pick FROM range(100) d, i s)"
    " SELECT draw, sum(dt)::BIGINT AS dialect_total, sum(de)::BIGINT AS dialect_error, sum(pt)::BIGINT AS plain_total, sum(pe)::BIGINT AS plain_error FROM d JOIN i ON i.i = d.pick GROUP BY draw"
)
def q15_bootstrap_draws(spark, sf_dir):
    """A hundred resamplings of the clusters of all cohorts, pooled."""
    columns = ["dialect_total", "dialect_error", "plain_total", "plain_error"]
    return stats.bootstrap_draws(_clusters(spark, sf_dir), "review_id", columns, 100)


@query()
def q16_bootstrap_interval(spark, sf_dir):
    b = stats.bootstrap(_clusters(spark, sf_dir))
    return b.select(*[_r9(F.element_at(f"{c}_ci", i)).alias(f"{c}_{n}") for c in ("dialect_rate", "plain_rate", "difference") for i, n in ((1, "low"), (2, "high"))], _r9(F.col("difference_se")).alias("difference_se"))


@query()
def q17_permutation_test(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    units = c.select("review_id", F.explode(F.concat(*[F.array_repeat(F.struct(F.lit(d).alias("is_dialect"), F.lit(e).alias("is_error")), n) for d, e, n in ((True, True, F.col("dialect_error")), (True, False, F.col("dialect_total") - F.col("dialect_error")), (False, True, F.col("plain_error")), (False, False, F.col("plain_total") - F.col("plain_error")))])).alias("u")).select("review_id", "u.*")
    return stats.permutation_test(units)


# ---- mining and grading ------------------------------------------------------------------------------------------

_CUES = (("negation", ("no", "not", "never")), ("intent_cue", ("cancel", "order", "change")), ("confirmation", ("yes", "right")))
_AMT, _DAY = "[0-9]+ ?(?:usd|eur|%)", "(?:today|tomorrow|[0-9]+ ?am|[0-9]+ ?pm)"
_SPAN_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS span_text, '{c}' AS category FROM documents" for p, c in ((_AMT, "amount"), (_DAY, "date_time"))]
    + [f"SELECT doc_id, '{cue}', '{name}' FROM documents WHERE contains(text, '{cue}')" for name, group in _CUES for cue in group]
)


@query(f"SELECT category, span_text, count(*) AS n FROM ({_SPAN_SQL}) GROUP BY ALL")
def q18_substring_mining(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.explode(mining.substring_spans("text", amount=_AMT, date_time=_DAY, cues=_CUES)).alias("s"))
    return d.groupBy("s.category", "s.span_text").agg(F.count(F.lit(1)).alias("n"))


_RULES = (("negation", "exact", ("no", "not")), ("negation", "prefix", ("never",)), ("intent_cue", "prefix", ("the", "tion")), ("confirmation", "exact", ("de",)))
_TOKENS = "SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: regexp_replace(w, '[^0-9A-Za-z가-힣%,]', '', 'g')), lambda w: w <> '') AS ts FROM documents"
_NUM, _UNIT = "[0-9,일이삼사오육칠팔구십백천만억]+", "(?:원|만원|천원|프로|%)"
_RULE_SQL = " UNION ".join(
    [
        f"SELECT doc_id, CASE WHEN regexp_matches(t, '^{_NUM}\\s?{_UNIT}') THEN regexp_extract(t, '^{_NUM}\\s?{_UNIT}') WHEN regexp_full_match(t, '{_NUM}') AND regexp_matches(after, '^{_UNIT}') THEN t || ' ' || regexp_extract(after, '^{_UNIT}') END AS span_text, 'amount' AS category FROM tk",
        "SELECT doc_id, nullif(regexp_extract(t, '^(?:[0-9]+월|[0-9]+일|[0-9]+시|[0-9]+분)'), ''), 'date_time' FROM tk",
        *(f"SELECT doc_id, '{w}', 'date_time' FROM tk WHERE starts_with(t, '{w}')" for w in mining.DATE_WORDS),
        *(f"SELECT doc_id, '{cue}', '{name}' FROM tk WHERE " + (f"t = '{cue}'" if mode == "exact" else f"starts_with(t, '{cue}')") for name, mode, group in _RULES for cue in group),
    ]
)


@query(f"WITH l AS ({_TOKENS}), tk AS (SELECT doc_id, unnest(ts) AS t, coalesce(unnest(list_append(ts[2:], NULL)), '') AS after FROM l), s AS ({_RULE_SQL}) SELECT category, span_text, count(*) AS n FROM s WHERE span_text IS NOT NULL GROUP BY ALL")
def q19_boundary_mining(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.explode(mining.boundary_spans("text", rules=_RULES)).alias("s"))
    return d.groupBy("s.category", "s.span_text").agg(F.count(F.lit(1)).alias("n"))


_MINED = (
    ("해지 안 된다 캤나?", "안/negation,해지/intent_cue", "해지/intent_cue,안/negation"),
    ("비슷해지면", "해지/intent_cue", ""),
    ("그러네요", "네/confirmation", ""),
    ("안녕", "안/negation", ""),
    ("아니 맞나?", "아니/negation,맞/confirmation,아니/confirmation", "아니/negation,아니/confirmation,맞/confirmation"),
    ("15만 원", "15만 원/amount", "15만 원/amount"),
    ("15만원", "15만원/amount", "15만원/amount"),
    ("이 원칙은", "이 원/amount", "이 원/amount"),
    ("9월 26일", "9월/date_time,26일/date_time", "9월/date_time,26일/date_time"),
    ("일이 프로", "일이 프로/amount", "일이 프로/amount"),
)


@query(f"SELECT * FROM (VALUES {_values(_MINED)}) t(transcript, by_substring, by_boundary)")
def q20_korean_mining(spark, sf_dir):
    rows = spark.createDataFrame([(m[0],) for m in _MINED], "transcript string")
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws("/", x["span_text"], x["category"])), ",")
    return rows.select("transcript", told(mining.substring_spans("transcript")).alias("by_substring"), told(mining.boundary_spans("transcript")).alias("by_boundary"))


_NUMBERS = (("백삼십만", 1300000), ("일이", None), ("이천이십육", 2026), ("십오만", 150000), ("만", 10000), ("조", 10**12), ("천천", 2000))
_VALUES = (("15만 원", "150000"), ("80만원", "800000"), ("1,500원", "1500"), ("9월 26일", "9,26"), ("일이 프로", ""), ("1억 2천만", "2000,10000,100000000"), ("3백만", "3,1000000"), ("하지만", "10000"), ("조금", "1000000000000"), ("천천히", "2000"))


@query(f"SELECT * FROM (VALUES {_values(_NUMBERS)}) t(run, value)")
def q21_sino_numerals(spark, sf_dir):
    return spark.createDataFrame([(r,) for r, _ in _NUMBERS], "run string").select("run", numerals.parse_sino("run").alias("value"))


@query(f"SELECT * FROM (VALUES {_values(_VALUES)}) t(text, found)")
def q22_numeric_values(spark, sf_dir):
    return spark.createDataFrame([(r,) for r, _ in _VALUES], "text string").select("text", F.array_join(numerals.numeric_values("text").cast("array<string>"), ",").alias("found"))


_GRADES = (
    ("네", "네 그래요", "네 맞아요", "eojeol_initial"),
    ("네", "네 그래요", "그러네요", "substring_only"),
    ("해지", "비슷해지면", "해지", "phantom_label"),
    ("안 된다", "해지 안 된다 캤나?", "안 된다", "phantom_label"),
    ("오늘", "오늘 갔어", "갔어", "unresolved_numeral"),
    ("어제", "어제 갔어", "갔어", "absent"),
    ("9월 26일", "", "9월 27일", "numeral_equivalent"),
    ("15만 원", "", "50만 원", "absent"),
    ("만 원", "", "하지만 괜찮아", "numeral_equivalent"),
)


@query(f"SELECT * FROM (VALUES {_values(_GRADES)}) t(span, reference, hypothesis, match_type)")
def q23_span_match_types(spark, sf_dir):
    rows = spark.createDataFrame([g[:3] for g in _GRADES], "span string, reference string, hypothesis string")
    return rows.select("span", "reference", "hypothesis", scoring.match_type("span", "hypothesis", [F.col("reference")]).alias("match_type"))


_NEEDLES = ("the", "tion", "re", "zz")
_LOSS = " UNION ALL ".join(
    f"SELECT role, '{n}' AS span, CASE WHEN NOT list_contains(list_transform(regexp_split_to_array(ref, '\\s+'), lambda w: starts_with({_NORM.format('w')}, '{n}')), true) THEN 'phantom_label' WHEN list_contains(list_transform(regexp_split_to_array(hyp, '\\s+'), lambda w: starts_with({_NORM.format('w')}, '{n}')), true) THEN 'eojeol_initial' WHEN contains({_NORM.format('hyp')}, '{n}') THEN 'substring_only' ELSE 'absent' END AS m FROM turns"
    for n in _NEEDLES
)


@query(
    f"WITH {_TURNS}, o AS ({_LOSS}), g AS (SELECT role, span, count(*) AS labelled, count(*) FILTER (m = 'phantom_label') AS phantom, count(*) FILTER (m = 'eojeol_initial') AS preserved, count(*) FILTER (m = 'substring_only') AS ambiguous, count(*) FILTER (m = 'absent') AS absent FROM o GROUP BY ALL)"
    " SELECT *, labelled - phantom AS scorable, round((absent / nullif(labelled - phantom, 0))::DOUBLE, 9) AS strict_loss, round(((labelled - phantom - preserved) / nullif(labelled - phantom, 0))::DOUBLE, 9) AS inclusive_loss FROM g"
)
def q24_span_losses(spark, sf_dir):
    t = _turns(spark, sf_dir).select("role", "ref", "hyp", F.explode(F.array(*map(F.lit, _NEEDLES))).alias("span"))
    out = scoring.span_losses(t.select("role", "span", scoring.match_type("span", "hyp", [F.col("ref")]).alias("match_type")), ["role", "span"])
    return out.withColumn("strict_loss", _r9(F.col("strict_loss"))).withColumn("inclusive_loss", _r9(F.col("inclusive_loss")))


_DOM = (("first", ("the", "und")), ("second", ("de", "la")), ("third", ("en",)))


@query("SELECT CASE WHEN contains(text, 'the') OR contains(text, 'und') THEN 'first' WHEN contains(text, 'de') OR contains(text, 'la') THEN 'second' WHEN contains(text, 'en') THEN 'third' ELSE 'other' END AS domain, lang, count(*) AS n FROM documents GROUP BY ALL")
def q25_domains(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(mining.domain("text", _DOM).alias("domain"), "lang").agg(F.count(F.lit(1)).alias("n"))


# ---- sampling ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256('119:' || doc_id), doc_id) <= 3")
def q26_stratified_sample(spark, sf_dir):
    return sampling.stratified(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


_LABELS = (("a", "the"), ("b", "de"), ("c", "en"), ("d", "tion"))


@query(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS label FROM documents WHERE contains(text, '{w}')" for k, w in _LABELS) + "), s AS (SELECT doc_id FROM l QUALIFY row_number() OVER (PARTITION BY lang, label ORDER BY sha256('119:' || doc_id), doc_id) <= 5) SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM s)"
)
def q27_multilabel_sample(spark, sf_dir):
    labels = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), k) for k, w in _LABELS]))
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", labels.alias("labels"))
    return sampling.stratified_by_labels(d, ["lang"], "labels", "doc_id", 5).select("doc_id", "lang")


@query(
    "WITH h AS (SELECT event_type, user_id, substr(sha256(event_id::VARCHAR), 1, 16) AS review_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY review_id) AS r FROM h QUALIFY r <= 2)"
    " SELECT event_type, user_id, review_id, row_number() OVER (PARTITION BY event_type ORDER BY r, user_id) AS taken FROM r QUALIFY taken <= 40"
)
def q28_round_robin_split(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", "user_id", text.stable_hash(F.col("event_id").cast("string")).alias("review_id"))
    return sampling.round_robin(e, "event_type", "user_id", "review_id", 40, 2).select("event_type", "user_id", "review_id", F.col("taken").cast("long").alias("taken"))


@query()
def q29_greedy_quota(spark, sf_dir):
    labels = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), k) for k, w in _LABELS]))
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", labels.alias("labels"))
    return sampling.greedy_quota(d, "doc_id", "lang", "labels", "doc_id", ["en", "fr"], ["a", "b", "c", "d"], 50)


@query("SELECT doc_id, substr(sha256(source || ':' || doc_id), 1, 16) AS utterance_hash, lang, n_chars FROM documents")
def q30_redacted_manifest(spark, sf_dir):
    return review.redact(_read(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars"], {"utterance_hash": F.concat_ws(":", "source", F.col("doc_id").cast("string"))}).select("doc_id", "utterance_hash", "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) AND n_chars >= 200")
def q31_semi_anti_pool(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").filter("n_chars >= 200").select("doc_id", "lang")
    labels, bench = _read(spark, sf_dir, "labels").select("doc_id"), _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return d.join(labels, "doc_id", "left_semi").join(bench, "doc_id", "left_anti")


@query("SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY CASE quality WHEN 1 THEN 1 ELSE 2 END, doc_id) AS place FROM labels WHERE quality IN (0, 1)")
def q32_status_order(spark, sf_dir):
    """Rows by status, then id, with their place in that order, which the partitions' counts and local ranks give."""
    rows = _read(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected"))
    ordered = sampling.by_status(rows, "status", ("accepted", "rejected"), "doc_id").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    from pyspark.sql.window import Window

    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    out = ordered.join(F.broadcast(before.select("_part", "_before", "_first")), "_part")
    return out.select("doc_id", "quality", "toxic", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place"))


# ---- quality of data ---------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_rows, count(*) FILTER (json_valid(props) AND json_extract(props, '$.k') IS NOT NULL) AS with_k, sum((json_extract(props, '$.k')::BIGINT)) AS total_k FROM events")
def q33_json_profile(spark, sf_dir):
    v = F.try_parse_json("props")
    e = _read(spark, sf_dir, "events").select(F.try_variant_get(v, "$.k", "long").alias("k"))
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("with_k"), F.sum("k").alias("total_k"))


@query("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN role NOT IN ('user', 'assistant') THEN 'enum' END AS rule FROM conversations UNION ALL SELECT CASE WHEN turn % 5 = 0 THEN 'additional' END FROM conversations UNION ALL SELECT CASE WHEN turn % 3 = 0 THEN 'required' END FROM conversations) WHERE rule IS NOT NULL GROUP BY rule")
def q34_schema_violations(spark, sf_dir):
    """Rows turned to JSON with faults of known kinds, and the violations found in them."""
    c = _read(spark, sf_dir, "conversations").filter("text is not null")
    row = F.to_json(F.struct(F.when(F.col("turn") % 3 != 0, F.col("conv_id").cast("string")).alias("id"), F.col("role").alias("kind"), F.when(F.col("turn") % 5 == 0, 1).alias("extra")))
    found = validate.violations(row, required=("id", "kind"), strings=("id", "kind"), enums={"kind": ("user", "assistant")}, items={}, known=("id", "kind"), booleans=(), filled=())
    return c.select(F.explode(found).alias("v")).groupBy("v.rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l.doc_id, d.lang, d.source FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1")
def q35_gold_freeze(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = _read(spark, sf_dir, "labels").withColumn("review_status", F.when(F.col("quality") == 1, "accepted").otherwise("rejected")).join(d, "doc_id")
    return review.freeze(rows.select(F.col("doc_id").alias("review_id"), "review_status", F.struct("lang", "source").alias("final_annotation"))).withColumnRenamed("review_id", "doc_id")


@query(
    "WITH e AS (SELECT event_id, value AS s, value + (event_id % 50) / 10.0 AS e, 1600000 AS f FROM events), w AS (SELECT event_id, greatest(0, trunc((s - 0.25) * 16000)::BIGINT) AS a, least(f, trunc((e + 0.25) * 16000)::BIGINT) AS b FROM e)"
    " SELECT event_id, a AS first_frame, b AS last_frame, round((b - a) / 16000.0::DOUBLE, 9) AS seconds FROM w WHERE b > a"
)
def q36_clip_windows(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", F.col("value").alias("s"), (F.col("value") + (F.col("event_id") % 50) / 10.0).alias("e"))
    w = e.withColumn("w", review.clip_window("s", "e", F.lit(1600000))).filter("w is not null")
    return w.select("event_id", F.col("w.first").alias("first_frame"), F.col("w.last").alias("last_frame"), _r9(F.col("w.seconds")).alias("seconds"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role ORDER BY n DESC, min(conv_id * 1000 + turn) LIMIT 1")
def q37_mode(spark, sf_dir):
    return sampling.mode_of(_read(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn")), "role", "at")


@query("SELECT source, lang, count(*) AS n, count(DISTINCT n_chars) AS lengths, round(sum(n_chars) / 60, 2) AS minutes FROM documents GROUP BY ALL")
def q38_packet_counts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_chars").alias("lengths"), F.round(F.sum("n_chars") / 60, 2).alias("minutes"))


# ---- whole analyses ------------------------------------------------------------------------------------------------

_OPENING = "regexp_replace(lower(string_split(ref, ' ')[1]), '[^a-z]', '', 'g')"


def _match_sql(x: str) -> str:
    opens = lambda t: f"list_contains(list_transform(regexp_split_to_array({t}, '\\s+'), lambda w: starts_with({_NORM.format('w')}, {x})), true)"
    return f"CASE WHEN NOT {opens('ref')} THEN 'phantom_label' WHEN {opens('hyp')} THEN 'eojeol_initial' WHEN contains({_NORM.format('hyp')}, {x}) THEN 'substring_only' ELSE 'absent' END"


_GRADED_SQL = " UNION ALL ".join(
    [f"SELECT role, 'critical_span' AS source, '{n}' AS category, 'high' AS risk, {_match_sql(repr(n))} AS m FROM turns" for n in _NEEDLES]
    + [f"SELECT role, 'slot', 'opening', 'unspecified', {_match_sql(_OPENING)} FROM turns WHERE {_OPENING} <> ''", f"SELECT role, 'slot', 'fixed', 'unspecified', {_match_sql(repr('the'))} FROM turns"]
)


@query(f"WITH {_TURNS}, o AS ({_GRADED_SQL}) SELECT role AS cohort, source, category, risk AS business_risk, m AS match_type, count(*) AS n FROM o GROUP BY ALL")
def q39_span_outcomes(spark, sf_dir):
    """Turns as annotations with critical spans and slots, of which some have no text, graded against the next turn; of repeated
    hypotheses the last line counts."""
    t = _turns(spark, sf_dir).withColumn("id", (F.col("conv_id") * 1000 + F.col("turn")).cast("string"))
    opening = F.regexp_replace(F.lower(F.get(F.split("ref", " "), F.lit(0))), "[^a-z]", "")
    span = lambda text, name: F.struct(F.lit(text).alias("span_text"), F.lit(name).alias("category"), F.lit("high").alias("business_risk"))
    slot = lambda name, value, text: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(text).alias("span_text"))
    slots = F.array(slot("opening", opening, ""), slot("fixed", F.lit("other"), "the"), slot("empty", F.lit(""), None))
    annotations = t.select(F.col("id").alias("utterance_id"), F.col("ref").alias("dialect_transcript"), F.lit("").alias("standard_transcript"), F.array(*[span(n, n) for n in _NEEDLES], span("", "empty")).alias("critical_spans"), slots.alias("slots"))
    units = F.array(F.struct(F.lit("the").alias("dialect")))
    manifest = t.select(F.col("id").alias("utterance_id"), F.concat(F.lit("r"), "id").alias("review_id"), F.col("role").alias("cohort"), units.alias("dialect_units"))
    line = lambda at: F.struct(F.lit("a").alias("file"), F.lit(at).alias("at")).alias("_line")
    asr = t.select(F.concat(F.lit("r"), "id").alias("review_id"), F.col("hyp").alias("hypothesis"), line(2))
    asr = asr.unionByName(asr.select("review_id", F.lit("an earlier line").alias("hypothesis"), line(1)))
    out = workflows.span_outcomes(annotations, manifest, asr)
    return out.groupBy("cohort", "source", "category", "business_risk", "match_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT l.doc_id AS review_id, (l.doc_id % 3)::BIGINT AS unit_index, CASE quality WHEN 0 THEN 'potentially_harmful_semantic_shift' ELSE 'low_impact_discourse_or_hedge_loss' END AS text_audit_status, d.source || '.wav' AS clip_path, d.source IN (SELECT source FROM documents WHERE doc_id % 5 = 0) AS clip_present,"
    " CASE WHEN d.doc_id % 4 <> 0 THEN round(d.n_chars / 100.0::DOUBLE, 2) END AS start_sec, d.text AS dialect_transcript FROM labels l JOIN documents d USING (doc_id) WHERE quality IN (0, 1)"
)
def q40_audio_packet(spark, sf_dir):
    """Labels as audited units, documents as utterances, three quarters of them with a clip."""
    d, id = _read(spark, sf_dir, "documents"), F.col("doc_id").alias("review_id")
    no = lambda *names: [F.lit("").alias(c) for c in names]
    status = F.when(F.col("quality") == 0, review.AUDIO_STATUSES[0]).when(F.col("quality") == 1, review.AUDIO_STATUSES[1]).otherwise("other")
    audit = _read(spark, sf_dir, "labels").select(id, (F.col("doc_id") % 3).cast("long").alias("unit_index"), status.alias("text_audit_status"), *no("utterance_id", "cohort", "category", "dialect", "standard", "automatic_outcome", "text_audit_reason", "text_audit_note", "hypothesis"))
    path = F.concat("source", F.lit(".wav"))
    manifest = d.select(id, path.alias("clip_path"), F.col("text").alias("dialect_transcript"), F.lit("").alias("standard_transcript"))
    clips = d.filter("doc_id % 4 <> 0").select(id, F.round(F.col("n_chars") / 100, 2).alias("start_sec"), F.lit(0.0).alias("end_sec"), F.lit(0.0).alias("clip_duration_sec"), *no("domain", "intent"), F.array(F.lit("a")).alias("critical_categories"))
    packet = review.audio_packet(audit, manifest, clips, d.filter("doc_id % 5 = 0").select(path.alias("path")))
    return packet.select("review_id", "unit_index", "text_audit_status", "clip_path", "clip_present", "start_sec", "dialect_transcript")


@query("SELECT doc_id, lang, n_chars, (SELECT max(doc_id) FROM labels WHERE toxic = 1) - doc_id AS rank FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q41_rows_in_order(spark, sf_dir):
    """The rows that a selection names, in its order: the last ids first."""
    ids = _read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    last = ids.agg(F.max("doc_id")).first()[0] or 0
    chosen = ids.withColumn("rank", F.lit(last) - F.col("doc_id"))
    return keyed.in_order(_read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), chosen, "doc_id", "rank")
