"""The shards of the mix are those of the splitting tree."""

from collections import Counter

from hearken.llm import mixing


def test_mixing_deals_what_the_tree_says(spark, monkeypatch):
    """Sources of few long documents, which leave blocks empty."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20_000)
    sizes = {"a": [20_000] * 20, "b": [9_000] * 30 + [10] * 5, "c": [50] * 400}
    docs = spark.createDataFrame([(f"{s}{i}", s, "w " * n) for s, of in sizes.items() for i, n in enumerate(of)], "doc_id string, source string, text string")
    seen, tables = {}, []
    written, tree = mixing.written, mixing.splitting_tree
    monkeypatch.setattr(mixing, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: tables.append(tree(*a)) or tables[-1])
    mixing.plan_mix(docs)
    got = Counter((r["source"], k) for r in seen["dealt_blocks"].collect() for k in r["shards"])
    assert len(tables[0][0]) > 1
    assert got == Counter({(s, k): int(n) for s, row in zip("abc", tables[0]) for k, n in enumerate(row) if n})
