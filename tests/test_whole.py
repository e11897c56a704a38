"""Queries take whole texts and all rows: small tables against plain Python."""

import hashlib
import random
import re

import pytest
from test_queries import SF

from hearken.operators import stats
from hearken.plans import queries



def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_word_edits_beyond_the_fortieth_word(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(150)}" for _ in range(n)) for n in (120, 97, 41, 130, 7)]
    sf = conversations(spark, tmp_path, [(0, i, "user", t) for i, t in enumerate(texts)])
    split = [t.split() for t in texts]
    r = queries.QUERIES["q02_word_error_rates"](spark, sf).first()
    assert (r["role"], r["words"]) == ("user", sum(map(len, split[:-1])))
    assert r["word_edits"] == sum(map(distance, split, split[1:]))


def test_turns_that_are_not_ascii(spark, tmp_path):
    texts = ["déjà vu naïve façade", "deja vu 😀😀 naïve", "plain words only here", "네 맞아요 extraordinary", "맞나 extraordinary 😀"]
    sf = conversations(spark, tmp_path, [(0, i, "user", t) for i, t in enumerate(texts)])
    run = lambda name: queries.QUERIES[name](spark, sf)
    letters, split = [t.replace(" ", "") for t in texts], [t.split() for t in texts]
    r = run("q01_turn_error_rates").first()
    assert (r["turns"], r["edits"], r["chars"]) == (4, sum(map(distance, letters, letters[1:])), sum(map(len, letters[:-1])))
    r = run("q02_word_error_rates").first()
    assert (r["word_edits"], r["words"]) == (sum(map(distance, split, split[1:])), sum(map(len, split[:-1])))
    r = run("q03_slot_f1").first()
    assert (r["tp"], r["fp"], r["fn"]) == tuple(sum(len(f(set(b), set(a))) for a, b in zip(split, split[1:])) for f in (set.__and__, set.__sub__, lambda b, a: a - b))
    plain = lambda t: re.sub("[^0-9A-Za-z가-힣]", "", t)
    lost = lambda w, hyp: not (plain(w) and plain(w) in plain(hyp))
    want = []
    for i, (ref, hyp) in enumerate(zip(split, texts[1:])):
        long, short = [w for w in ref if len(w) >= 8], [w for w in ref if len(w) < 8]
        want.append((i, "user", len(long), sum(lost(w, hyp) for w in long), len(short), sum(lost(w, hyp) for w in short)))
    assert sorted(map(tuple, run("q09_clusters").collect())) == want


def test_resampling_takes_clusters_of_all_cohorts(spark):
    c = queries.QUERIES["q09_clusters"](spark, SF).cache()
    table = sorted(tuple(r)[:1] + tuple(r)[2:] for r in c.collect())
    n = len(table)
    pick = lambda draw, slot: int(hashlib.md5(f"bootstrap-{draw}-{slot}".encode()).hexdigest()[:15], 16) % n
    want = [(d, *map(sum, zip(*[table[pick(d, s)][1:] for s in range(n)]))) for d in range(100)]
    assert sorted(map(tuple, queries.QUERIES["q15_bootstrap_draws"](spark, SF).collect())) == want
    whole = stats.rates(c).first()
    r = queries.QUERIES["q16_bootstrap_interval"](spark, SF).first()
    for rate in ("dialect_rate", "plain_rate", "difference"):
        assert r[f"{rate}_low"] < whole[rate] < r[f"{rate}_high"]
    p, exact = queries.QUERIES["q17_permutation_test"](spark, SF).first(), stats.permutation_null(c).first()
    assert p["observed"] == pytest.approx(whole["difference"], abs=1e-12) and 1 / 20_001 <= p["p"] < 1 / 51
    assert abs(p["null_mean"] - exact["null_mean"]) < 5 * exact["null_sd"] / 20_000**0.5
    assert p["null_sd"] == pytest.approx(exact["null_sd"], rel=0.03)
