"""Clusters by density: core distances, a minimum spanning tree, the condensed tree and its most stable clusters.

The distance of two points is their euclidean one, or the core distance of either
(to its k-th nearest neighbour) if that is larger. No table of all pairs is made
and no vector is shuffled to others: blocks of points, kept as rows of one table,
meet two by two in a product of that table with itself, whose tasks read the blocks
from it. What leaves a task are the nearest few of each of its points.

Borůvka rounds find the spanning tree on those lists: each component takes its
cheapest edge, components join, inner edges go. An edge that isn't listed is at
least as dear as the last of its point's list, so a component's cheapest listed edge
is its cheapest one as long as it is cheaper than the last of all its points' lists.
When no component can tell any more, the points of all but the largest look again
for their nearest few, now outside their components.

Of more copies of a vector than the core distance looks at, all at distance 0
of each other, only the one of the smallest id takes part, with their number as
its weight; the others share its cluster.

The tree's edges, cheapest first, tell how points merge. They are taken in
bands of distance, half of what is left at a time; within a band the parts that
its edges connect are merged each on its own, in a task for each. What goes on to
the next band is one small row for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.operators import blocks
from noema.operators.components import components
from noema.sources.store import cut, drop

#: Places to which distances are rounded; nearer than the last place counts as this far.
PLACES, LEAST = 9, 1e-9
#: Nearest ones that are listed for a point, at least; by how much a distance from a product of matrices may be off; rows of a block that are compared, and pairs that are measured, at a time.
LISTED, SLACK, ROWS, PAIRS = 16, 1e-7, 512, 16_384
#: Edges of the last band.
BAND = 100_000


def unit(points: DataFrame) -> DataFrame:
    """points (id, v) with vectors of length 1; a vector of zeros stays."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return points.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).select("id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))


def collapsed(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """head and m, the copies that it stands for, of points (id, v); and the heads themselves (id, v, m). Up to ``k`` copies stay as they are, each its own head."""
    many = points.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies")).where(F.col("copies") > k)
    told = cut(points.join(blocks.small(cut(many)), "v", "left").select("id", "v", F.coalesce("low", "id").alias("head"), F.coalesce("copies", F.lit(1)).cast("long").alias("m")))
    return told.select("id", "head"), cut(told.where("id = head").select("id", "v", "m"))


_BLOCK = {"ids": "int64", "m": "int64", "core": "float64", "c": "int64", "v": "float64"}
_NEAR = "id long, near array<struct<w: double, b: long, c: long, m: long>>"


def packed(points: DataFrame) -> DataFrame:
    """A row for each block of points (id, m, core, c, v): ``block``, its smallest id, and a column of bytes for each of theirs."""
    size = 2 * blocks.BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # of one task: about as many points as a block has
        rows = pa.Table.from_batches(held) if held else pa.table({"id": []})
        for start in range(0, rows.num_rows, size):
            part = rows.slice(start, size).combine_chunks()
            v = part["v"].combine_chunks()
            if len(set(v.value_lengths().to_pylist())) > 1:
                raise ValueError("vectors of different lengths")
            told = {"ids": part["id"], "m": part["m"], "core": part["core"], "c": part["c"], "v": v.flatten()}
            block = int(np.min(told["ids"].to_numpy()))
            yield pa.RecordBatch.from_pydict({"block": [block]} | {name: [np.ascontiguousarray(told[name].to_numpy(), dtype).tobytes()] for name, dtype in _BLOCK.items()})

    rows = points.select(F.col("id").cast("long").alias("id"), F.col("m").cast("long").alias("m"), F.col("core").cast("double").alias("core"), F.col("c").cast("long").alias("c"), "v")
    return cut(rows.repartition(max(1, -(-points.count() // size)), "id").mapInArrow(pack, "block long, " + ", ".join(f"{name} binary" for name in _BLOCK)))


class _Lists:
    """The nearest ``k`` of a block's points (by distance, then id) among those met so far that are of other components."""

    def __init__(self, x: dict[str, np.ndarray], k: int):
        self.x, self.k, n = x, k, len(x["ids"])
        self.w, self.b, self.c, self.m = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def meet(self, y: dict[str, np.ndarray]) -> None:
        x, twice, yy, cores = self.x, -2 * y["v"], (y["v"] ** 2).sum(1), y["core"] ** 2
        shared = np.isin(x["c"], y["c"])
        for start in range(0, len(x["ids"]), ROWS):
            at = slice(start, start + ROWS)
            v, core = x["v"][at], x["core"][at]
            sq = v @ twice.T
            sq += (v**2).sum(1)[:, None]
            sq += yy
            if cores.any():
                np.maximum(sq, cores, out=sq)
            own = np.flatnonzero(shared[at])
            if len(own):
                sq[own] = np.where(x["c"][at][own, None] == y["c"], np.inf, sq[own])
            # no vector is farther than 2 from another
            near = sq <= (np.minimum(self.w[at, -1], 3.0) + SLACK)[:, None] ** 2
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k)
            if len(many):
                last = np.partition(sq[many], self.k - 1, axis=1)[:, self.k - 1]
                near[many] &= sq[many] <= (np.maximum(np.sqrt(np.clip(last, 0, 9)), core[many]) + SLACK)[:, None] ** 2
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            w = np.empty(len(i))
            for s in (slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)):
                # the same for both ends and in every block
                apart = v[i[s]] - y["v"][j[s]]
                w[s] = np.maximum(np.round(np.sqrt(np.einsum("ij,ij->i", apart, apart)), PLACES), np.maximum(core[i[s]], y["core"][j[s]]))
            if len(i):
                self._fold(at, i, w, y["ids"][j], y["c"][j], y["m"][j])

    def _fold(self, at: slice, i: np.ndarray, *new: np.ndarray) -> None:
        held = (self.w[at], self.b[at], self.c[at], self.m[at])
        n = len(held[0])
        row, *all_ = np.concatenate([np.repeat(np.arange(n), self.k), i]), *(np.concatenate([h.ravel(), x]) for h, x in zip(held, new, strict=True))
        order = np.lexsort((all_[1], all_[0], row))
        first = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(self.k)]
        self.w[at], self.b[at], self.c[at], self.m[at] = (x[first] for x in all_)

    def rows(self) -> pa.RecordBatch:
        there = np.isfinite(self.w)
        ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(x[there]) for x in (self.w, self.b, self.c, self.m)], names=["w", "b", "c", "m"])
        return pa.RecordBatch.from_pydict({"id": pa.array(self.x["ids"]), "near": pa.ListArray.from_arrays(pa.array(ends), near)})


def nearest(asked: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """id, near of the asked: the ``k`` nearest of the others that are of another component (w, b: distance and id; c, m: component and copies), nearest first, then by id. Both as ``packed``."""

    def opened(batch: pa.RecordBatch, r: int, side: str) -> dict[str, np.ndarray]:
        x = {name: np.frombuffer(batch.column(side + name)[r].as_buffer(), dtype) for name, dtype in _BLOCK.items()}
        return x | {"v": x["v"].reshape(len(x["ids"]), -1)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, _Lists] = {}
        for batch in batches:
            for r, block in enumerate(batch.column("x_block").to_pylist()):
                if block not in lists:
                    # its own bytes, as the batch goes
                    lists[block] = _Lists({name: x.copy() for name, x in opened(batch, r, "x_").items()}, k)
                lists[block].meet(opened(batch, r, "y_"))
        for told in lists.values():
            yield told.rows()

    side = lambda df, s: df.select(*[F.col(c).alias(s + c) for c in ("block", *_BLOCK)])
    # tasks read the blocks from where they are kept: nothing is broadcast or dealt out
    pairs = side(asked, "x_").hint("shuffle_replicate_nl").crossJoin(side(others, "y_"))
    return pairs.mapInArrow(meet, _NEAR).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def core_distances(points: DataFrame, k: int) -> DataFrame:
    """id, v, m, core, near of points (id, v, m): the distance to the k-th nearest other point, or the farthest where there are fewer (of more than ``k`` copies, 0), and the list of the nearest."""
    dealt = packed(points.select("id", "m", F.lit(0.0).alias("core"), F.col("id").alias("c"), "v"))
    low = nearest(dealt, dealt, max(LISTED, k))
    # a neighbour of more copies than k is the k-th wherever it stands
    heavy = F.array_position(F.transform("near", lambda x: x.m > k), True)
    place = F.least(F.size("near"), F.lit(k), F.when(heavy > 0, heavy.cast("int")))
    kth = F.when(F.size("near") > 0, F.element_at("near", place).w).otherwise(0.0)
    return points.join(low, "id", "left").select("id", "v", "m", F.when((F.col("m") > k) | F.col("near").isNull(), 0.0).otherwise(kth).alias("core"), "near")


def _renamed(df: DataFrame, joined: DataFrame, *names: str) -> DataFrame:
    """df with the components in the named columns replaced by those that they are in now."""
    for name in names:
        df = df.join(joined.select(F.col("node").alias(name), F.col("component").alias("_now")), name, "left").withColumn(name, F.coalesce("_now", name)).drop("_now")
    return df


def spanning_tree(points: DataFrame, k: int) -> DataFrame:
    """a, b, w: the edges of the minimum spanning tree of points (id, v, m, core, near) with lists of the ``k`` nearest, by Borůvka rounds; of equal weights the smaller ids go first."""
    far = F.when(F.size("near") >= k, F.element_at("near", -1).w - SLACK).otherwise(float("inf"))
    ends = points.select(F.col("id").alias("i"), F.col("core").alias("own"), F.explode("near").alias("e")).select("i", "own", "e.w", "e.b").join(points.select(F.col("id").alias("b"), "core"), "b")
    ends = ends.select(F.least("i", "b").alias("a"), F.greatest("i", "b").alias("b"), F.greatest("w", "own", "core").alias("w")).distinct()
    left = cut(ends.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    #: what is cheaper than ``far`` is surely the cheapest of component c
    reach = cut(points.select(F.col("id").alias("c"), F.coalesce(far, F.lit(float("inf"))).alias("far")))
    at = cut(points.select("id", F.col("id").alias("c")))
    taken = [points.sparkSession.createDataFrame([], "a long, b long, w double")]
    sure = F.lit(False)
    while True:
        while True:
            edge = F.struct("w", "a", "b", "ca", "cb").alias("e")
            both = left.select(F.col("ca").alias("c"), edge).unionByName(left.select(F.col("cb").alias("c"), edge))
            chosen = both.groupBy("c").agg(F.min("e").alias("e")).join(reach, "c").where((F.col("e.w") < F.col("far")) | sure)
            chosen = cut(chosen.select("e.*").distinct())
            if chosen.isEmpty():
                break
            sure = F.lit(False)
            taken.append(chosen.select("a", "b", "w"))
            joined = cut(components(chosen.select(F.col("ca").alias("x"), F.col("cb").alias("y"))))
            left = cut(_renamed(left, joined, "ca", "cb").where("ca <> cb"), left)
            reach = cut(_renamed(reach, joined, "c").groupBy("c").agg(F.min("far").alias("far")), reach)
            at = cut(_renamed(at, joined, "c"), at)
        largest = at.groupBy("c").count().orderBy(F.desc("count"), "c").limit(2).collect()
        if len(largest) < 2:
            break
        now = cut(points.select("id", "v", "m", "core").join(at, "id"))
        asked = now.where(F.col("c") != largest[0].c)
        near = cut(asked.select("id", "c").join(nearest(packed(asked), packed(now), k), "id"))
        drop(left)
        found = near.select("id", F.col("c").alias("own"), F.explode("near").alias("e")).select(F.least("id", "e.b").alias("a"), F.greatest("id", "e.b").alias("b"), "e.w", F.when(F.col("id") < F.col("e.b"), F.col("own")).otherwise(F.col("e.c")).alias("ca"), F.when(F.col("id") < F.col("e.b"), F.col("e.c")).otherwise(F.col("own")).alias("cb"))
        left = cut(found.distinct())
        drop(reach)
        # the largest didn't look; the others have just seen their cheapest
        reach = cut(near.select("c", far.alias("far")).groupBy("c").agg(F.min("far").alias("far")).unionByName(points.sparkSession.createDataFrame([(largest[0].c, float("-inf"))], "c long, far double")))
        sure = F.col("far") > float("-inf")
        drop(now)
        if left.isEmpty():
            raise ValueError("points without a distance to others")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return cut(out)


_STATE = "node long, size long, points array<long>, cluster string, total double, kids double"
_OUT = "kind string, point long, cluster string, parent string, birth double, own boolean, " + _STATE.replace("cluster string", "at string").replace("node long", "node long")


def _close(c: dict, parent: str | None, d: float) -> tuple[tuple, float]:
    """A cluster's row as it ends at distance d, and the stability of the best choice below and with it."""
    stability = c["total"] - c["size"] / d
    own = c["kids"] is None or c["kids"] <= stability
    return ("c", None, c["cluster"], parent, d, own), stability if own else c["kids"]


def merge(states: list[dict], edges: list[tuple[int, int, float]], least: int) -> tuple[list[tuple], dict]:
    """Merges one connected part by its edges, which come with the nodes they join, cheapest first; rows of points and clusters that are done, and the part's new state."""
    held = {s["node"]: s for s in states}
    parent = {s["node"]: s["node"] for s in states}
    rows: list[tuple] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, w in edges:
        d = max(w, LEAST)
        x, y = held.pop(find(a)), held.pop(find(b))
        parent[y["node"]] = x["node"]
        new = {"node": x["node"], "size": x["size"] + y["size"], "points": [], "cluster": None, "total": 0.0, "kids": None}
        big = [s for s in (x, y) if s["cluster"]]
        small = [p for s in (x, y) if not s["cluster"] for p in s["points"]]
        few = sum(s["size"] for s in (x, y) if not s["cluster"])
        if len(big) == 2:
            new["cluster"] = f"{a}-{b}"
            done = [_close(s, new["cluster"], d) for s in big]
            rows += [r for r, _ in done]
            new |= {"total": new["size"] / d, "kids": sum(best for _, best in done)}
        elif len(big) == 1:
            new |= {"cluster": big[0]["cluster"], "total": big[0]["total"] + few / d, "kids": big[0]["kids"]}
        elif new["size"] >= least:
            new |= {"cluster": f"{a}-{b}", "total": new["size"] / d}
        else:
            new["points"] = small
        if new["cluster"]:
            rows += [("p", p, new["cluster"], None, None, None) for p in small]
        held[x["node"]] = new
    (last,) = held.values()
    return rows, last


def condensed(tree: DataFrame, points: DataFrame, least: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Of points (id, m) point, cluster: the cluster out of which each point falls; and cluster, parent, birth, own: the condensed tree, ``own`` where a cluster is more stable than those below it."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def task(g: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = g[g["w"].isna()], g[g["w"].notna()].sort_values(["w", "low", "high"])
        states = [{"node": int(r.node), "size": int(r.size_), "points": list(r.points), "cluster": r.cluster, "total": r.total, "kids": None if r.kids is None or np.isnan(r.kids) else r.kids} for r in nodes.rename(columns={"size": "size_"}).itertuples()]
        rows, last = merge(states, list(zip(edges["a"].astype("int64"), edges["b"].astype("int64"), edges["w"], strict=True)), least)
        out = [(*r, *[None] * 6) for r in rows] + [("s", None, None, None, None, None, last["node"], last["size"], last["points"], last["cluster"], last["total"], last["kids"])]
        return pd.DataFrame(out, columns=names)

    # enough copies are a cluster of their own from the start
    own = F.col("m") >= least
    state = points.select(F.col("id").alias("node"), F.col("m").alias("size"), F.when(own, F.array().cast("array<long>")).otherwise(F.array("id")).alias("points"), F.when(own, F.concat_ws("-", "id", "id")).alias("cluster"), F.when(own, F.col("m") / F.lit(LEAST)).otherwise(0.0).alias("total"), F.lit(None).cast("double").alias("kids"))
    left = cut(tree.select("w", F.col("a").alias("low"), F.col("b").alias("high"), "a", "b"))
    done = points.where(own).select(F.lit("p").alias("kind"), F.col("id").alias("point"), F.concat_ws("-", "id", "id").alias("cluster"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("birth"), F.lit(None).cast("boolean").alias("own"))
    n = left.count()
    while n:
        if n > band:
            top = left.select(F.percentile_approx("w", 0.5, 10_000).alias("w")).first().w
            now = left.where(F.col("w") <= top)
        else:
            now = left
        groups = components(now.select(F.col("a").alias("x"), F.col("b").alias("y"))).select("node", F.col("component").alias("g"))
        inner = now.join(groups.select(F.col("node").alias("a"), "g"), "a")
        empty = lambda df: df.select("g", "a", "b", "w", "low", "high", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _STATE.split(", ")])
        nodes = state.join(groups, "node").select("g", *[F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("w", "double"), ("low", "long"), ("high", "long"))], *[c.split()[0] for c in _STATE.split(", ")])
        out = cut(empty(inner).unionByName(nodes).groupBy("g").applyInPandas(task, _OUT))
        rows = out.where("kind <> 's'").select("kind", "point", "cluster", "parent", "birth", "own")
        done = done.unionByName(rows)
        merged = out.where("kind = 's'").select("node", "size", "points", F.col("at").alias("cluster"), "total", "kids")
        state = cut(state.join(groups, "node", "left_anti").unionByName(merged))
        if n <= band:
            break
        # the nodes of later edges are the parts of this band
        heads = out.where("kind = 's'").select(F.col("node").alias("head")).join(groups, F.col("head") == F.col("node")).select("head", "g")
        to = groups.join(heads, "g").select("node", "head")
        later = left.where(F.col("w") > top)
        for end in ("a", "b"):
            later = later.join(to.select(F.col("node").alias(end), "head"), end, "left").withColumn(end, F.coalesce("head", end)).drop("head")
        left = cut(later.select("w", "low", "high", "a", "b"))
        n = left.count()
    root = state.where("cluster is not null").select(F.lit("c").alias("kind"), F.lit(None).cast("long").alias("point"), "cluster", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("birth"), F.lit(False).alias("own"))
    done = done.unionByName(root)
    return cut(done.where("kind = 'p'").select("point", "cluster")), cut(done.where("kind = 'c'").select("cluster", "parent", "birth", "own"))


def climb(tree: DataFrame, mark: Column, first: bool) -> DataFrame:
    """cluster, found: the first (or else the topmost) marked one on the way up from each cluster, itself included; the ways double each round."""
    now = cut(tree.select("cluster", F.col("parent").alias("up"), F.when(mark, F.col("cluster")).alias("found")))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("found").alias("found2"))
        found = F.coalesce("found", "found2") if first else F.coalesce("found2", "found")
        now = cut(now.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), found.alias("found")), now)
    return now


def clusters(points: DataFrame, least: int = 5, samples: int = 3, epsilon: float = 0.5, band: int = BAND) -> DataFrame:
    """id, cluster (from 0, by the smallest id in it; -1 is noise) of points (id, v), compared as unit vectors.

    ``least``: points of a cluster; ``samples``: which neighbour gives the core
    distance; clusters that part below ``epsilon`` stay together. The whole is
    never a cluster. Fewer than ``least`` points are all noise. Vectors that are
    null or hold nulls or what is not finite take no part.
    """
    some = cut(unit(points.where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")))
    n = some.count()
    if n < max(least, 2):
        return some.select("id", F.lit(-1).alias("cluster"))
    members, heads = collapsed(some, samples)
    tree = spanning_tree(cut(core_distances(heads, samples)), max(LISTED, samples))
    fell, kinds = condensed(tree, heads.select("id", "m"), least, band)
    roots = kinds.where("parent is null").select(F.col("cluster").alias("parent"), F.lit(True).alias("top"))
    kinds = cut(kinds.join(F.broadcast(roots), "parent", "left").withColumn("top", F.coalesce("top", F.lit(False))))
    chosen = climb(kinds, F.col("own") & F.col("parent").isNotNull(), first=False).where("found is not null").select("found").distinct()
    # a choice that parts from its sibling below epsilon gives way to the one above
    apart = climb(kinds, F.col("parent").isNotNull() & (F.col("top") | (F.col("birth") >= epsilon)), first=True).select(F.col("cluster").alias("found"), F.col("found").alias("target"))
    targets = chosen.join(apart, "found").select(F.col("target").alias("cluster"), F.lit(True).alias("mark")).distinct()
    labels = climb(kinds.join(targets, "cluster", "left"), F.col("mark").isNotNull(), first=False).where("found is not null").select("cluster", "found")
    headed = fell.join(labels, "cluster").select(F.col("point").alias("head"), "found")
    of = cut(members.join(blocks.small(cut(headed)), "head", "left").select("id", "found"))
    # one row for each cluster
    order = of.where("found is not null").groupBy("found").agg(F.min("id").alias("low")).orderBy("low").select(F.collect_list("found").alias("names"))
    return of.join(F.broadcast(order)).select("id", F.when(F.col("found").isNull(), -1).otherwise(F.array_position("names", F.col("found")).cast("int") - 1).alias("cluster"))
