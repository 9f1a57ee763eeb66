"""The pruned cosine join against all pairs."""

import numpy as np
import pytest

from noema.operators import cosine_join


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


def all_pairs(a, b, threshold):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit(a) @ unit(b).T, 4)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(sim >= threshold), strict=True) if i != j}


@pytest.mark.parametrize(("threshold", "block"), [(0.85, 2048), (0.999, 50), (0.2, 100)])
def test_same_pairs_as_all(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(cosine_join, "BLOCK", block)
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(40, 16)), 20, axis=0) + 0.15 * r.normal(size=(800, 16))
    x[100:140] = x[100]  # a cell of equal vectors
    plan = cosine_join.Plan(frame(spark, x), frame(spark, x), threshold, pivots=30)
    want = all_pairs(x, x, threshold)
    got = [(p.a, p.b) for p in plan.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_clusters_meet_few_others(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(60, 24)), 30, axis=0) + 0.05 * r.normal(size=(1800, 24))
    plan = cosine_join.Plan(frame(spark, x), frame(spark, x), 0.95, pivots=60)
    assert plan.share < 0.2
    assert {(p.a, p.b) for p in plan.pairs().collect()} == all_pairs(x, x, 0.95)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.1])], "id long, v array<double>")
    assert [(p.a, p.b) for p in cosine_join.Plan(rows, rows, 0.9).pairs().orderBy("a").collect()] == [(1, 4), (4, 1)]
    none = rows.where("id > 9")
    assert cosine_join.Plan(none, rows, 0.9).pairs().count() == cosine_join.Plan(none, none, 0.9).pairs().count() == 0
