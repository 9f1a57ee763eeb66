"""Facts of two sources: each set of characters is compared once, however many rows have it, and the counts are those of all pairs."""

import numpy as np
import pandas as pd

from noema.operators import blocks, categories


def _all_pairs(rows):
    """source, characters, confidence and n of each row."""
    want = {}
    for a, x, p, m in rows:
        for b, y, q, n in rows:
            if a < b:
                x_, y_ = set(x) or {""}, set(y) or {""}
                sim = len(x_ & y_) / len(x_ | y_)
                w = want.setdefault((a, b), [0, 0])
                w[0] += m * n * (sim > 0.5 and p > 0.7 and q > 0.7)
                w[1] += m * n * (0.15 < sim <= 0.4 and abs(p - q) > 0.2)
    return want


def test_a_set_is_compared_once_for_all_its_rows(spark, monkeypatch):
    met = []

    def within(rows, *more):
        met.append(rows.count())
        return blocks.within(rows, *more)

    monkeypatch.setattr(categories, "within", within)
    facts = [(f"s{k % 3}", ["abcdef", "fedcbaa", "abxyz", "mnbc"][k % 4], (k * 37 % 101) / 100) for k in range(120)]
    got = categories.compare_sources(spark.createDataFrame(facts, "source string, fact string, confidence double")).collect()
    assert {(r.source_a, r.source_b): [r.agreeing, r.conflicting] for r in got} == _all_pairs([(*f, 1) for f in facts])
    assert met == [3]


def test_texts_without_characters_agree_and_sources_without_facts_are_there(spark):
    facts = [("a", "", 0.9), ("b", "", 0.8), ("b", "x", 0.9), ("c", None, 0.9), (None, "", 0.9)]
    got = categories.compare_sources(spark.createDataFrame(facts, "source string, fact string, confidence double")).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1, 0), ("a", "c", 0, 0), ("b", "c", 0, 0)]


def test_a_block_without_rows_is_not_met(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 1)
    rows = spark.range(5).withColumn("h", (blocks.F.col("id") * 0).cast("long"))
    got = blocks.within(rows, lambda g, second: pd.DataFrame({"n": [len(g)]}), "n long").collect()
    assert sum(r.n for r in got) == 5


def test_counts_of_two_blocks(monkeypatch):
    from noema.operators import letters

    rng = np.random.default_rng(1)
    for trial in range(12):
        for name, v in zip(("TILE", "FEW", "RUNS"), (5, 3, 4) if trial % 2 else (2048, 16, 128), strict=True):
            monkeypatch.setattr(letters, name, v)
        many = trial % 3 == 0
        alphabet = [chr(0x4E00 + k) for k in range(300)] if many else list("abcdefghijkl")
        rows, sets = [], []
        for c in sorted({"".join(sorted(set(rng.choice(alphabet, rng.integers(0, 40 if many else 9))))) for _ in range(25)}):
            k = rng.integers(1, 6)
            source, sure, n = [f"s{x}" for x in rng.integers(0, 5, k)], rng.random(k) if trial % 4 < 2 else rng.integers(0, 101, k) / 100, rng.integers(1, 20, k)
            rows += zip(source, [c] * k, sure, n, strict=True)
            sets.append((c, np.array(source, object), sure, n))
        g = pd.DataFrame(sets, columns=["chars", "source", "confidence", "n"])
        half, none, got = rng.random(len(g)) < 0.5, lambda k: np.zeros(k, bool), {}
        for part in (letters.compared(g, half), letters.compared(g[half], none(half.sum())), letters.compared(g[~half], none((~half).sum()))):
            for r in part.itertuples():
                w = got.setdefault((r.source_a, r.source_b), [0, 0])
                w[0], w[1] = w[0] + r.agreeing, w[1] + r.conflicting
        want = {k: v for k, v in _all_pairs(rows).items() if any(v)}
        assert got == want
        assert {(r.source_a, r.source_b): [r.agreeing, r.conflicting] for r in letters.compared(g, none(len(g))).itertuples()} == want
