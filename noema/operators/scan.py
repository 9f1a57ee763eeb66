"""Sequences of a key folded in pieces: a key that holds most rows is still many tasks.

A window over a key is one task for each key. Here rows are dealt by ranges of key
and order, so a long sequence lies in several pieces. Each piece is worked on
alone and leaves a small carry; the carries of a key, one for each piece, are
scanned in order; and what comes before a piece is applied to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noema.sources.store import cut


def pieces(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with the column ``piece``: within a key, every row of a lower piece comes before those of a higher one. Equal keys and orders share a piece."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return cut(dealt.withColumn("piece", F.spark_partition_id()))


def before(carries: DataFrame, key: str, **scans: Column) -> DataFrame:
    """carries (key, piece, ...) with further columns, each a window expression of the rows up to the piece before; one row for each piece of a key."""
    earlier = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return carries.select("*", *[c.over(earlier).alias(n) for n, c in scans.items()])


def _within(key: str, *order: str):
    return Window.partitionBy(key, "piece").orderBy(*order)


def _applied(rows: DataFrame, carries: DataFrame, key: str) -> DataFrame:
    """Each row with its piece's carry; a null key is a key, too."""
    c = carries.withColumnRenamed(key, "_key").withColumnRenamed("piece", "_piece")
    return rows.join(c, rows[key].eqNullSafe(c["_key"]) & (rows["piece"] == c["_piece"])).drop("_key", "_piece")


def last_known(rows: DataFrame, key: str, value: str, *order: str, name: str = "known") -> DataFrame:
    """rows with the last value that isn't null up to each row (``name``), and the smallest of the key (``least``)."""
    held = pieces(rows, key, *order)
    w = _within(key, *order)
    local = held.withColumn("_local", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.struct(*order, value)
    carries = held.groupBy(key, "piece").agg(F.max_by(value, F.when(F.col(value).isNotNull(), here)).alias("_last"), F.min(value).alias("_min"))
    carries = before(carries, key, _carried=F.last("_last", ignorenulls=True))
    carries = carries.withColumn("least", F.min("_min").over(Window.partitionBy(key))).drop("_last", "_min")
    return _applied(local, carries, key).withColumn(name, F.coalesce("_local", "_carried")).drop("_local", "_carried", "piece")


def neighbours(rows: DataFrame, key: str, value: str, *order: str, name: str = "earlier") -> DataFrame:
    """rows with the value of the row before of the same key (``name``), null at the first."""
    held = pieces(rows, key, *order)
    w = _within(key, *order)
    local = held.withColumn("_n", F.row_number().over(w)).withColumn("_local", F.lag(value).over(w))
    carries = held.groupBy(key, "piece").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carries = before(carries, key, _carried=F.last("_last")).drop("_last")
    earlier = F.when(F.col("_n") > 1, F.col("_local")).otherwise(F.col("_carried.v"))
    return _applied(local, carries, key).withColumn(name, earlier).drop("_n", "_local", "_carried", "piece")


def running(rows: DataFrame, key: str, value: str, *order: str, name: str = "total") -> DataFrame:
    """rows with the sum of a value up to each row (``name``)."""
    held = pieces(rows, key, *order)
    local = held.withColumn("_local", F.sum(value).over(_within(key, *order).rowsBetween(Window.unboundedPreceding, 0)))
    carries = before(held.groupBy(key, "piece").agg(F.sum(value).alias("_sum")), key, _carried=F.sum("_sum")).drop("_sum")
    return _applied(local, carries, key).withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0))).drop("_local", "_carried", "piece")
