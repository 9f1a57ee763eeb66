"""The graph of source files: which file holds which function, and which function calls which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.sources.store import cut


def code_edges(functions: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) of functions (path, name, calls): CONTAINS from a file, CALLS to names that some file defines."""
    functions = cut(functions.select("path", "name", "calls"))  # read three times, parsed once
    holds = functions.select(F.col("path").alias("src"), F.col("name").alias("dst"), F.lit("CONTAINS").alias("kind"))
    called = functions.select(F.col("name").alias("src"), F.explode("calls").alias("dst"), F.lit("CALLS").alias("kind"))
    inside = called.join(functions.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "kind")
    return holds.unionByName(inside).distinct()


def callers_and_callees(edges: DataFrame, part: str) -> DataFrame:
    """Functions whose name has ``part`` in it, with what calls them and what they call."""
    calls = edges.where("kind = 'CALLS'")
    named = edges.where("kind = 'CONTAINS'").groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("files")).where(F.col("name").contains(part))
    by = calls.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    to = calls.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    return named.join(by, "name", "left").join(to, "name", "left")
