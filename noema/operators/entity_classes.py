"""Entities that are said to be the same, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.operators.components import components


def classes(pairs: DataFrame, aliases: int = 1000) -> DataFrame:
    """canonical, names, aliases of each class of the names in pairs (a, b).

    The canonical name is the smallest. Of the others the first ``aliases`` are
    listed, in order; ``names`` counts all, so a huge class is never one array.
    """
    of = components(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))).select(F.col("component").alias("canonical"), "node")
    n = of.groupBy("canonical").agg(F.count("*").alias("names"))
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("node"))
    some = of.where("node <> canonical").withColumn("r", rank).where(F.col("r") <= aliases).groupBy("canonical").agg(F.array_sort(F.collect_list("node")).alias("aliases"))
    return n.join(some, "canonical", "left").select("canonical", "names", "aliases")
