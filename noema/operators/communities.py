"""Communities by modularity: the Louvain method in rounds that move many nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.sources.store import cut, drop


def met(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined with right, neither of which is broadcast: both grow with the graph, and the bytes of their files say little of their rows."""
    return left.join(right.hint("merge"), on)


def weighted(edges: DataFrame) -> DataFrame:
    """The undirected projection of edges (src, dst, conf): src, dst, w from both ends; what a loop weighs counts twice."""
    e = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(links: DataFrame, member: DataFrame) -> float:
    """Of a division (node, c) of links (src, dst, w)."""
    at = met(met(links, member.select(F.col("node").alias("src"), F.col("c").alias("a")), "src"), member.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
    whole = links.agg(F.sum("w")).first()[0] or 1.0
    by = at.groupBy("a").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return by.agg(F.sum(F.col("inside") / whole - F.pow(F.col("tot") / whole, F.lit(2)))).first()[0] or 0.0


def _moved(links: DataFrame, member: DataFrame, degree: DataFrame, whole: float, turn: int) -> DataFrame:
    """The division after those nodes have moved whose turn it is and who gain by it; half of the nodes, so that neighbours don't swap places for ever."""
    total = met(member, degree, "node").groupBy("c").agg(F.sum("k").alias("tot"))
    own = met(member, degree, "node").select(F.col("node").alias("src"), F.col("c").alias("own"), "k")
    near = met(links.where("src <> dst"), member.select(F.col("node").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("w").alias("w"))
    # staying is a choice too, also for a node without a link to its own community
    choices = near.unionByName(own.select("src", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("src", "c").agg(F.sum("w").alias("w"))
    rated = met(met(choices, own, "src"), total, "c").withColumn("gain", F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / whole, 9))
    best = rated.groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.max("own").alias("own"))
    goes = (-F.col("best.g") > F.col("stay")) & (F.pmod(F.xxhash64("src"), F.lit(2)) == turn % 2)
    return best.select(F.col("src").alias("node"), F.when(goes, F.col("best.c")).otherwise(F.col("own")).alias("c"))


def louvain(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """node, community (its smallest node) of edges (src, dst): moves for up to ``rounds`` at each level, then communities become nodes; a level that adds no modularity is not kept."""
    links = cut(weighted(edges))
    base, result, reached = links, None, -1.0
    whole = links.agg(F.sum("w")).first()[0]
    if not whole:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("community")).limit(0)
    for _ in range(levels):
        degree = cut(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        member = cut(degree.select("node", F.col("node").alias("c")))
        for turn in range(rounds):
            member = cut(_moved(links, member, degree, whole, turn), member)
        now = member if result is None else met(result, member.select(F.col("node").alias("c"), F.col("c").alias("next")), "c").select("node", F.col("next").alias("c"))
        now = cut(now)
        found = modularity(base, now)
        if found <= reached + 1e-9:
            drop(now)
            break
        drop(result)
        result, reached = now, found
        names = lambda end, to: member.select(F.col("node").alias(end), F.col("c").alias(to))  # noqa: B023, E731
        smaller = met(met(links, names("src", "a"), "src"), names("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        smaller = cut(smaller)
        if links is not base:
            drop(links)
        drop(degree)
        links = smaller
    first = result.groupBy("c").agg(F.min("node").alias("community"))
    return met(result, first, "c").select("node", "community")
