"""Density clustering against a plain version that goes the other way: from the whole down."""

import random

import numpy as np
import pytest

from noema.operators import blocks, density
from noema.operators.components import components

SF = "/root/testdata/sf0.001"


def plain(ids, vectors, least, samples, eps):
    """Labels by the full table of distances, cutting the tree from its dearest edge down."""
    x = np.array(vectors, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    d = np.round(np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)), 9)
    n = len(ids)
    core = np.array([sorted(np.delete(d[i], i))[min(samples, n - 1) - 1] for i in range(n)])
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    order = sorted((w[i, j], ids[i], ids[j], i, j) for i in range(n) for j in range(n) if ids[i] < ids[j])
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    tree = []
    for e in order:
        a, b = find(e[3]), find(e[4])
        if a != b:
            up[a] = b
            tree.append(e)

    def part(members, edges):
        near = {m: [] for m in members}
        for e in edges:
            near[e[3]].append(e[4])
            near[e[4]].append(e[3])
        seen, todo = set(), [edges_start := min(members)]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        return seen

    clusters = []

    def fall(members, edges, birth, parent):
        """Follows one cluster down until it splits; returns its place in ``clusters``."""
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "total": 0.0, "size": len(members), "points": [], "kids": []})
        while True:
            if not edges:
                raise AssertionError
            edges = sorted(edges)
            cut_at, edges = edges[-1], edges[:-1]
            lam = 1 / max(cut_at[0], 1e-9)
            one = side(members, edges, cut_at[3])
            two = members - one
            if len(one) >= least and len(two) >= least:
                clusters[me]["total"] += lam * len(members)
                for s in (one, two):
                    clusters[me]["kids"].append(fall(s, [e for e in edges if e[3] in s], max(cut_at[0], 1e-9), me))
                return me
            for s in (one, two):
                if len(s) < least:
                    clusters[me]["total"] += lam * len(s)
                    clusters[me]["points"] += s
            stays = one if len(one) >= least else two if len(two) >= least else None
            if stays is None:
                return me
            members, edges = stays, [e for e in edges if e[3] in stays]

    def side(members, edges, start):
        near = {m: [] for m in members}
        for e in edges:
            near[e[3]].append(e[4])
            near[e[4]].append(e[3])
        seen, todo = set(), [start]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        return seen

    if n < least:
        return {i: -1 for i in ids}
    fall(set(range(n)), tree, None, None)
    chosen = set()

    def best(c):
        below = sum(best(k) for k in clusters[c]["kids"])
        if c == 0:
            return below
        stability = clusters[c]["total"] - clusters[c]["size"] / clusters[c]["birth"]
        if clusters[c]["kids"] and below > stability:
            return below
        drop(c)
        chosen.add(c)
        return stability

    def drop(c):
        for k in clusters[c]["kids"]:
            chosen.discard(k)
            drop(k)

    best(0)
    targets = set()
    for c in chosen:
        while clusters[c]["birth"] < eps and clusters[c]["parent"] != 0:
            c = clusters[c]["parent"]
        targets.add(c)
    label = {}

    def spread(c, name):
        name = c if name is None and c in targets else name
        for p in clusters[c]["points"]:
            label[ids[p]] = name
        for k in clusters[c]["kids"]:
            spread(k, name)

    spread(0, None)
    low = {}
    for i, name in label.items():
        if name is not None:
            low[name] = min(low.get(name, i), i)
    number = {name: k for k, name in enumerate(sorted(low, key=low.get))}
    return {i: -1 if label[i] is None else number[label[i]] for i in ids}


def blobs(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    sizes = [0.02, 0.05, 0.1, 0.15, 0.3, 0.02]
    at = r.integers(0, 6, n)
    x = centres[at] + r.normal(size=(n, 8)) * np.array(sizes)[at][:, None]
    x[: n // 10] = r.normal(size=(n // 10, 8))
    x[n // 2 : n // 2 + 8] = x[n // 2]  # equal ones
    ids = [int(k) for k in r.permutation(n) * 7]
    return ids, x


def labels(df):
    return {r.id: r.cluster for r in df.collect()}


@pytest.mark.parametrize(("seed", "n", "eps", "block", "band"), [(1, 240, 0.0, 2048, 100_000), (2, 300, 0.3, 70, 100_000), (3, 260, 0.05, 90, 40)])
def test_as_the_plain_version(spark, monkeypatch, seed, n, eps, block, band):
    monkeypatch.setattr(blocks, "BLOCK", block)
    ids, x = blobs(seed, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    want = plain(ids, x, 5, 3, eps)
    assert len(set(want.values())) > 3
    assert labels(density.clusters(df, 5, 3, eps, band)) == want


def test_few_points_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    assert labels(density.clusters(df)) == {1: -1, 4: -1}


def test_components(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (999, 999)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r_.node: r_.component for r_ in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: find(x) for ab in links for x in ab}


def test_copies_meet_as_one(spark, monkeypatch):
    """5,000 rows of 12 vectors beside single ones: the blocks meet the vectors, not the rows; clusters are those of the whole table."""
    rows = []
    met = density.core_distances
    monkeypatch.setattr(density, "core_distances", lambda points, k: rows.append(points.count()) or met(points, k))
    x = [[1.0 * (g == k) for k in range(4)] + [0.01 * j] for g in range(4) for j in range(3)]
    some = [(k, x[k % 12]) for k in range(5000)] + [(10_000 + k, [0.1 * k, 1.0, -1.0, 0.3, 2.0]) for k in range(3)]
    got = labels(density.clusters(spark.createDataFrame(some, "id long, v array<double>")))
    assert rows == [15]
    assert all(got[k] == k % 12 // 3 for k in range(5000))
    # all rows alike are the whole, which is no cluster
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)], "id long, v array<double>")
    assert set(labels(density.clusters(same)).values()) == {-1}


@pytest.mark.parametrize(("seed", "samples", "least"), [(1, 3, 5), (2, 2, 6), (3, 4, 3)])
def test_copies_as_the_plain_version(spark, seed, samples, least):
    ids, x = blobs(seed, 150)
    r = np.random.default_rng(seed)
    x = np.vstack([x, *[np.repeat(x[j : j + 1], int(r.integers(1, 12)), axis=0) for j in range(0, 100, 5)]])
    ids = [int(k) for k in r.permutation(len(x))]
    # one length for all copies, so that the plain version sees them at 0
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    assert len(set(labels(density.clusters(df, least, samples, 0.0)).items()) ^ set(plain(ids, x, least, samples, 0.0).items())) == 0


def test_large_blocks_send_rows_to_fewer_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 10)
    rows = spark.range(400).selectExpr("id", "xxhash64(id) AS h")
    seen = lambda times: blocks.within(rows, lambda g, _: g[["id"]], "id long", times).count()
    assert seen(1) == 400 * 40 and seen(8) == 400 * 8


def shuffled(spark):
    """Rows that this session's stages have shuffled, by stage."""
    sc, gate = spark.sparkContext, spark.sparkContext._gateway
    some = sc._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (some.apply(k) for k in range(some.size()))}


def test_more_blocks_do_not_shuffle_the_vectors_more_often(spark, monkeypatch):
    """400 vectors in 40 blocks: dealt to every pair of blocks of half their size they were 32,000 rows."""
    monkeypatch.setattr(blocks, "BLOCK", 5)
    x = np.random.default_rng(1).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "id long, v array<double>, m long")
    before = shuffled(spark)
    core = {r.id: r.core for r in density.core_distances(points, 3).select("id", "core").collect()}
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < 10_000
    d = np.sort(np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)), axis=1)
    assert np.abs(d[:, 3] - [core[k] for k in range(400)]).max() < 1e-8


@pytest.mark.parametrize("kind", ["tight", "even"])
def test_short_lists_are_looked_up_again(spark, monkeypatch, kind):
    """Lists of three tell little of clusters of 20 points, or of points all equally far: the tree is that of all distances, of equal ones the smaller ids."""
    monkeypatch.setattr(blocks, "BLOCK", 15)
    monkeypatch.setattr(density, "LISTED", 3)
    passes = []
    met = density.nearest
    monkeypatch.setattr(density, "nearest", lambda *a: passes.append(1) or met(*a))
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(5, 6)), 20, axis=0) + r.normal(size=(100, 6)) * 0.01 if kind == "tight" else np.eye(40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [int(k) for k in r.permutation(len(x)) * 3]
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "id long, v array<double>, m long")
    got = {(e.a, e.b, e.w) for e in density.spanning_tree(density.cut(density.core_distances(points, 3)), 3).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    core = np.sort(d, axis=1)[:, 3]
    order = sorted((max(d[i, j], core[i], core[j]), ids[i], ids[j]) for i in range(len(x)) for j in range(len(x)) if ids[i] < ids[j])
    up = {i: i for i in ids}
    find = lambda k: k if up[k] == k else find(up[k])
    want = set()
    for w, a, b in order:
        if find(a) != find(b):
            up[find(b)] = find(a)
            want.add((a, b, w))
    assert got == want
    assert len(passes) > 1
