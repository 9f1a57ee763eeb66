"""The registry of texts as a stream: each arrival of a text takes its version up by one, also when a batch comes twice.

A batch is merged by writing the registry's next version as a whole, and every row
remembers the last batch that changed it. A batch that comes again, because the
job died between the write and the stream's own commit, finds its number there
and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.functions import scores
from noema.sources.store import Table

SCHEMA = "hash string, version long, first_id long, vector array<double>, batch long"
DIMS = 64


def table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, ["hash"], SCHEMA)


def arrivals(texts: DataFrame) -> DataFrame:
    """hash, new, first_id, vector of a batch of texts (id, text); null texts aren't registered."""
    some = texts.where("text is not null")
    return some.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("new"), F.min("id").alias("first_id"), F.min_by("text", "id").alias("text")).select("hash", "new", "first_id", scores.hash_vector(F.col("text"), DIMS).alias("vector"))


def merge(registry: Table, texts: DataFrame, batch: int) -> bool:
    """Registers a batch; False if it has been before."""
    known = registry.load()
    if not known.where(F.col("batch") >= batch).isEmpty():
        return False
    new = arrivals(texts).select("hash", "new", F.col("first_id").alias("new_id"), F.col("vector").alias("new_vector"))
    both = known.join(new, "hash", "full")
    registry.save(both.select(
        "hash", (F.coalesce("version", F.lit(0)) + F.coalesce("new", F.lit(0))).cast("long").alias("version"), F.least("first_id", "new_id").alias("first_id"),
        F.coalesce("vector", "new_vector").alias("vector"), F.when(F.col("new").isNotNull(), F.lit(batch)).otherwise(F.col("batch")).cast("long").alias("batch"),
    ))
    return True


def sink(registry: Table) -> Callable[[DataFrame, int], None]:
    return lambda texts, batch: merge(registry, texts, batch) and None
