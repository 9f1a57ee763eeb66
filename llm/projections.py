"""Operator 10: approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

With one more component that fills each vector up to the longest one's norm,
the largest inner product is the least Euclidean distance. Gaussian (2-stable)
projections, made orthogonal, keep distances: the squared projected distance
over the squared distance is about chi-square with as many degrees as there are
projections (orthogonal ones vary less, so the test is on the safe side).

The index is one kd-tree over the projected table, built once. Its upper levels
are cut at the medians of a bounded sample and deal all rows into leaves of
about ``SHARD``; a leaf of very many rows, such as copies of one vector, is
dealt by hash into lanes. Each leaf and lane is ordered by a kd-tree of its own
and written in that order.

A query searches its own leaf first, then, in rounds of ever more leaves, those
that are nearest to it, as long as the test does not hold for what comes next.
Within a leaf, the tree is walked by a heap, and projected neighbours come out
nearest first; each is verified on the original vectors, until a vector nearer
than the k-th found, by the ``RATIO`` that the answer may be off, would with
chance ``SURE`` have been projected nearer than the next.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import vectors as V
from llm.common import settle, unsettle

#: Projections, chance and ratio of the stopping test.
PROJECTED = 32
SURE = 0.9
RATIO = 1.05
#: Rows that the tree's upper levels are cut by, and their leaves, at most.
SAMPLE = 8192
LEAVES = 16384
#: Points of a leaf within a task, and points verified between two tests.
SMALL = 256
STEP = 96
#: Each round reaches so many times the leaves of the one before.
WIDER = 16
_SEED = 71
_FOUND = "query_id long, vec_id long, score double, verified long"


def chi_square_cdf(x: float, dims: int) -> float:
    """P(chi-square of ``dims`` degrees <= x)."""
    half = x / 2
    if dims % 2:
        above, term, at = math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half), 1.5
    else:
        above, term, at = math.exp(-half), half * math.exp(-half), 2.0
    for _ in range((dims - 1) // 2):
        above += term
        term *= half / at
        at += 1
    return 1 - above


def chi_square_quantile(sure: float, dims: int) -> float:
    a, b = 0.0, 10.0 * dims + 100
    for _ in range(80):
        a, b = ((a + b) / 2, b) if chi_square_cdf((a + b) / 2, dims) < sure else (a, (a + b) / 2)
    return b


def axes(width: int, dims: int) -> np.ndarray:
    """Orthogonal Gaussian directions for vectors of ``width`` components and the one that is added; scaled so that squared lengths are multiplied by ``dims`` on average."""
    g = np.random.Generator(np.random.PCG64(_SEED)).standard_normal((width + 1, min(dims, width + 1)))
    q, r = np.linalg.qr(g)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0) * math.sqrt(width + 1)


def project(v: np.ndarray, reach: float, dims: int, stored: bool) -> np.ndarray:
    """``stored`` vectors are filled up to the norm ``reach``; queries aren't."""
    a = axes(v.shape[1], dims)
    if not stored:
        return v @ a[:-1]
    return np.column_stack([v, np.sqrt(np.maximum(reach**2 - (v**2).sum(axis=1), 0))]) @ a


class Cuts:
    """The upper levels of the tree: ``axis`` (-1: a leaf), ``cut``, ``below`` and ``above`` of each node, ``leaf`` of each leaf node, and the leaves' boxes."""

    def __init__(self, p: np.ndarray, leaves: int):
        self.axis, self.cut, self.below, self.above, self.leaf = [], [], [], [], []
        low, high = [], []
        dims = p.shape[1]

        def grow(rows: np.ndarray, count: int, box: tuple[np.ndarray, np.ndarray]) -> int:
            at = len(self.axis)
            for x in (self.axis, self.below, self.above, self.leaf):
                x.append(-1)
            self.cut.append(0.0)
            wide = int(np.ptp(p[rows], axis=0).argmax()) if len(rows) > 1 else 0
            value = p[rows, wide]
            median = float(np.median(value)) if len(rows) > 1 else 0.0
            if len(rows) > 1 and median == value.max() > value.min():
                median = float(value[value < median].max())
            side = value > median
            if count < 2 or len(rows) < 2 or not side.any():
                self.leaf[at] = len(low)
                low.append(box[0])
                high.append(box[1])
                return at
            self.axis[at], self.cut[at] = wide, median
            down, up = (box[0], box[1].copy()), (box[0].copy(), box[1])
            down[1][wide] = up[0][wide] = median
            self.below[at] = grow(rows[~side], count // 2, down)
            self.above[at] = grow(rows[side], count - count // 2, up)
            return at

        grow(np.arange(len(p)), leaves, (np.full(dims, -np.inf), np.full(dims, np.inf)))
        self.axis, self.below, self.above, self.leaf = (np.array(x) for x in (self.axis, self.below, self.above, self.leaf))
        self.cut, self.low, self.high = np.array(self.cut), np.array(low), np.array(high)

    def of(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        while True:
            inner = self.axis[at] >= 0
            if not inner.any():
                return self.leaf[at]
            i = np.flatnonzero(inner)
            n = at[i]
            at[i] = np.where(p[i, self.axis[n]] > self.cut[n], self.above[n], self.below[n])

    def distance(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        return (gap * gap).sum(axis=1)


def ordered(p: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The points in the order of a kd-tree that halves the widest dimension, and for each its leaf."""
    todo, out = [np.arange(len(p))], []
    while todo:
        i = todo.pop()
        if len(i) <= small:
            out.append(i)
            continue
        wide = int(np.ptp(p[i], axis=0).argmax())
        order = i[np.argpartition(p[i, wide], len(i) // 2)]
        todo += [order[len(i) // 2 :], order[: len(i) // 2]]
    return np.concatenate(out), np.repeat(np.arange(len(out)), [len(i) for i in out])


class Tree:
    """The kd-tree of one leaf of the table, from its rows in order: boxes of the leaves, joined pairwise up to the root."""

    def __init__(self, p: np.ndarray, small: np.ndarray):
        start = np.flatnonzero(np.r_[True, small[1:] != small[:-1]])
        self.span = [*zip(start.tolist(), [*start[1:].tolist(), len(p)], strict=True)]
        low, high, self.kids = [*np.minimum.reduceat(p, start)], [*np.maximum.reduceat(p, start)], [()] * len(start)
        level = list(range(len(start)))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 2):
                kids = tuple(level[i : i + 2])
                if len(kids) == 1:
                    up.append(kids[0])
                    continue
                up.append(len(low))
                low.append(np.minimum(low[kids[0]], low[kids[1]]))
                high.append(np.maximum(high[kids[0]], high[kids[1]]))
                self.kids.append(kids)
            level = up
        self.low, self.high, self.root = np.array(low), np.array(high), level[0]

    def walk(self, q: np.ndarray, p: np.ndarray, limit) -> Iterator[np.ndarray]:
        """Indices by rising projected distance, some at a time, and their distances; ``limit()`` is the distance at which the walk ends, and may fall."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        near = (gap * gap).sum(axis=1).tolist()
        heap = [(near[self.root], self.root)]
        wait, far = np.zeros(0, np.int64), np.zeros(0)
        while True:
            first = far[0] if len(far) else np.inf
            new = []
            while heap and heap[0][0] <= first and heap[0][0] < limit():
                _, node = heapq.heappop(heap)
                for kid in self.kids[node]:
                    heapq.heappush(heap, (near[kid], kid))
                if not self.kids[node]:
                    a, b = self.span[node]
                    d = ((p[a:b] - q) ** 2).sum(axis=1)
                    first = min(first, d.min())
                    new.append((np.arange(a, b), d))
            if new:
                wait, far = np.concatenate([wait, *[i for i, _ in new]]), np.concatenate([far, *[d for _, d in new]])
                keep = far < limit()
                order = np.argsort(far[keep], kind="stable")
                wait, far = wait[keep][order], far[keep][order]
            edge = heap[0][0] if heap else np.inf
            some = min(STEP, int(np.searchsorted(far, min(edge, limit()), side="right")))
            if not some:
                return
            yield wait[:some]
            wait, far = wait[some:], far[some:]
            if len(far) and far[0] >= limit():
                far, wait = far[:0], wait[:0]


def search(tree: Tree, p: np.ndarray, v: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, own: int, k: int, held: np.ndarray, far: float, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the leaf's vectors that are among the k nearest found of these and ``held``, and how many were verified. far: the test's quantile over the squared ratio."""
    base = float(x @ x) + reach**2
    best = np.sort(held)[::-1][:k]
    got, score, verified = np.zeros(0, np.int64), np.zeros(0), 0

    def limit() -> float:
        return far * max(base - 2 * best[k - 1], 0.0) + 1e-9 if len(best) >= k else np.inf

    for some in tree.walk(q, p, limit):
        some = some[ids[some] != own]
        verified += len(some)
        got, score = V.top(np.concatenate([got, ids[some]]), np.concatenate([score, (v[some] * x).sum(axis=1)]), k)
        best = np.sort(np.concatenate([held, score]))[::-1][:k]
    if len(best) >= k:
        keep = score >= best[k - 1]
        got, score = got[keep], score[keep]
    return got, score, verified


def _found(vectors: DataFrame, every: int, k: int, shard: int, dims: int, sure: float, ratio: float, wider: int = WIDER) -> DataFrame | None:
    rows = settle(V.usable(vectors, zero=False).select("vec_id", "v", F.size("v").alias("width")))
    candidates = settle(V.of_equal_ones(rows, k))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # vectors of other lengths never meet, so each length has a tree; there are few lengths
    kinds = candidates.groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()
    asked = rows.where(F.col("vec_id") % every == 0)
    if not kinds or asked.isEmpty():
        return None
    drawn: dict[int, list] = {r.width: [] for r in kinds}
    for r in candidates.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).collect():
        drawn[r.width].append(r.v)
    cuts, reach, stop, first = {}, {}, {}, 0
    for r in kinds:
        reach[r.width] = math.sqrt(r.square) * (1 + 1e-12)
        of = min(dims, r.width + 1)
        stop[r.width] = chi_square_quantile(sure, of) / ratio**2
        sample = np.array(drawn[r.width] or [[0.0] * r.width])
        cuts[r.width] = (Cuts(project(sample, reach[r.width], dims, True), min(LEAVES, -(-r.n // shard))), first)
        first += len(cuts[r.width][0].low)
    blocks = max(1, -(-asked.count() // V.QUERIES))
    sent = rows.sparkSession.sparkContext.broadcast(cuts)  # at most LEAVES boxes a length

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = np.empty(len(b), np.int64)
            for w, i in b.groupby("width").indices.items():
                tree, start = sent.value[w]
                leaf[i] = start + tree.of(project(V.matrix(b["v"].iloc[i]), reach[w], dims, True))
            yield b.assign(leaf=leaf)

    kind = "vec_id long, v array<double>, width int, leaf long"
    placed = settle(candidates.mapInPandas(place, kind))
    loads = placed.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(2 * shard))).cast("int").alias("lanes"))
    lanes = settle(loads)  # a row for each leaf

    def build(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("vec_id", kind="stable")
        v, w = V.matrix(d["v"]), int(d["width"].iloc[0])
        order, small = ordered(project(v, reach[w], dims, True))
        return pd.DataFrame({"leaf": d["leaf"].iloc[0], "lane": d["lane"].iloc[0], "width": np.int32(w), "place": np.arange(len(d)), "small": small, "vec_id": d["vec_id"].to_numpy()[order], "v": list(v[order])})

    lane = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("lanes")).cast("int")
    index = settle(placed.join(F.broadcast(lanes), "leaf").select("leaf", lane.alias("lane"), "width", "vec_id", "v").groupBy("leaf", "lane").applyInPandas(build, "leaf long, lane int, width int, place long, small long, vec_id long, v array<double>"))
    queries = settle(asked.mapInPandas(place, kind).select(F.col("vec_id").alias("query_id"), "v", "width", F.col("leaf").alias("home"), V.block_of("vec_id", blocks).alias("block")))

    def task(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(d):
            d = d.sort_values("place")
            w = int(d["width"].iloc[0])
            v, ids = V.matrix(d["v"]), d["vec_id"].to_numpy()
            p = project(v, reach[w], dims, True)
            tree, x = Tree(p, d["small"].to_numpy()), V.matrix(q["v"])
            for y, z, own, held in zip(project(x, reach[w], dims, False), x, q["query_id"], q["held"], strict=True):
                got, score, verified = search(tree, p, v, ids, y, z, own, k, np.asarray(held, float), stop[w], reach[w])
                out += [(own, i, s, 0) for i, s in zip(got.tolist(), score.tolist(), strict=True)] + [(own, None, None, verified)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"], dtype=object).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})

    def route(a: int, b: int):
        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for q in batches:
                out = []
                for i in range(len(q)):
                    w, v, held = int(q["width"].iloc[i]), q["v"].iloc[i], q["held"].iloc[i]
                    tree, start = sent.value[w]
                    near = tree.distance(project(v[None], reach[w], dims, False)[0])
                    near[q["home"].iloc[i] - start] = -1
                    order = np.argsort(near, kind="stable")[a:b]
                    end = stop[w] * max(float(v @ v) + reach[w] ** 2 - 2 * held[k - 1], 0.0) + 1e-9 if len(held) >= k else np.inf
                    out.append((start + order[near[order] < end]).tolist())
                yield q.assign(leaf=out)

        return leaves

    kept, at, most = None, 0, max(len(c.low) for c, _ in cuts.values())
    while at < most:
        end = 1 if not at else min(most, at * wider)
        held = V.threshold_of(V.best_of(kept.where("vec_id is not null"), k), k) if kept is not None else None
        asked = queries.join(held, "query_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<double>"))) if held is not None else queries.withColumn("held", F.array().cast("array<double>"))
        asked = asked.mapInPandas(route(at, end), "query_id long, v array<double>, width int, home long, block int, held array<double>, leaf array<long>").withColumn("leaf", F.explode("leaf"))
        asked = asked.join(F.broadcast(lanes), "leaf").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        data = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        new = settle(asked.groupBy("leaf", "lane", "block").cogroup(data.groupBy("leaf", "lane", "block")).applyInPandas(task, _FOUND))
        both = new if kept is None else settle(kept.unionByName(new))
        for old in [] if kept is None else [kept, new]:
            unsettle(old)
        kept, at = both, end
    for used in (rows, candidates, placed, lanes, index, queries):
        unsettle(used)
    return kept


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = V.SHARD, dims: int = PROJECTED, sure: float = SURE, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by inner product in double precision; verified: vectors that the query was compared with.

    vectors: vec_id, embedding. Rows whose id is divisible by ``every`` are
    queries; all rows but the query's own are candidates. Ties go to the
    smaller vec_id. Null and zero vectors and those with null or non-finite
    components take no part, nor do null ids; vectors of different lengths
    don't meet. An empty table gives no rows. Rows that share a query's id are
    no candidates of it; several query rows of one id have one ranking together,
    in which a candidate may come once for each.
    """
    found = _found(vectors, every, k, shard, dims, sure, ratio)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    spent = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return V.best_of(found.where("vec_id is not null"), k).join(spent, "query_id").select("query_id", "rank", "vec_id", "score", "verified")
