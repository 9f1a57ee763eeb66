"""Input tables and the views derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noema.sources.store import kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One knowledge point for each document."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "text AS fact",
        "CASE doc_id % 5 WHEN 0 THEN 'concept' WHEN 1 THEN 'fact' WHEN 2 THEN 'method' WHEN 3 THEN 'opinion' ELSE 'pending' END AS category",
        "source",
        "lang",
        "CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence",
        "CAST(2 + doc_id % 4 AS DOUBLE) AS feedback_alpha",
        "CAST(2 + doc_id % 3 AS DOUBLE) AS feedback_beta",
        "CAST(doc_id % 9 AS INT) AS interaction_count",
        "date_add(DATE '2024-01-01', CAST((doc_id * 13) % 365 AS INT)) AS created_on",
        "CASE WHEN doc_id % 17 = 0 THEN 'replaced' WHEN doc_id % 23 = 0 THEN 'error' ELSE 'active' END AS status",
    )


_GRAPH = ("nation", "customer", "supplier", "orders")


def _edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer, supplier, orders = (read(spark, sf_dir, t) for t in _GRAPH)
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda df, src, dst, rel, conf: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("conf"))
    n, r, c, s, m = named("n", "n_nationkey"), named("r", "n_regionkey"), named("c", "c_custkey"), named("s", "s_suppkey"), named("m", "c_mktsegment")
    region = Window.partitionBy("n_regionkey")
    after = F.coalesce(F.lead("n_nationkey").over(region.orderBy("n_nationkey")), F.min("n_nationkey").over(region))
    causes = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_mktsegment", "o_orderpriority").distinct()
    rows = [
        edge(nation, n, r, "PART_OF", 0.9),
        edge(customer, c, named("n", "c_nationkey"), "BELONGS_TO", F.col("c_custkey") % 50 / 100 + 0.5),
        edge(supplier, s, named("n", "s_nationkey"), "BELONGS_TO", F.col("s_suppkey") % 50 / 100 + 0.5),
        edge(customer, c, m, "IS_A", 0.8),
        edge(causes, m, named("p", "o_orderpriority"), "CAUSES", 0.7),
        edge(nation.where("n_nationkey % 2 = 0"), r, n, "INDICATES", 0.6),
        edge(nation.withColumn("after", after), n, named("n", "after"), "CONFLICTS_WITH", 0.4),
    ]
    return reduce(DataFrame.unionByName, rows)


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph, kept: each edge from both ends, dealt and sorted by ``src``, so that what a node touches is read from few places.

    src, dst, rel, conf, forward (whether it is stored the way it points) and
    eid, the edge's own name; edges alike are numbered apart.
    """

    from noema.operators.graph import adjacent

    def make() -> DataFrame:
        return adjacent(_edge_rows(spark, sf_dir)).repartitionByRange("src").sortWithinPartitions("src", "dst")

    return kept(spark, "graph-1", [f"{sf_dir}/{t}.parquet" for t in _GRAPH], make)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, weighted edges between regions, nations, customers, suppliers, segments and priorities."""
    return adjacency(spark, sf_dir).where("forward").select("src", "dst", "rel", "conf")


def memory_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory upserts: user, type, key, value and time."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("memory_type"), k.alias("memory_key"), "value", "ts")
