"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.sources.store import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of links (x, y), in rounds that grow with the logarithm of the longest way.

    Each round links every node of a star to the star's least one, from both ends of
    the links by turns, until nothing changes. A node's links leave it towards its
    smallest neighbour only, so a hub's are spread over the others' keys; mins are
    taken before the shuffle.
    """
    now = cut(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    nodes = cut(links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct())
    while True:
        # large star: a node's larger neighbours go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = cut(large)
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        small = cut(small)
        same = small.count() == now.count() and small.exceptAll(now).isEmpty()
        now = small
        if same:
            break
    return nodes.join(now.select(F.col("x").alias("node"), "y"), "node", "left").select("node", F.coalesce("y", "node").alias("component"))
