"""Rows against rows in blocks of bounded size, and broadcasts behind a check of their size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task holds two.
BLOCK = 2048
#: Rows of a side that is still broadcast.
SMALL = 20_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns over all tasks, for work that costs much more than its rows' bytes: a table of few bytes is read by one task, and what is dealt without a number is put together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def _blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def against(asked: DataFrame, rows: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(asked block, rows block), both as pandas, for every block of a stated query set and every block of rows; both have an id."""
    n_asked, n_rows = _blocks(asked), _blocks(rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = asked.select("*", own(n_asked).alias("_a"), every(n_rows).alias("_b"))
    b = rows.select("*", every(n_asked).alias("_a"), own(n_rows).alias("_b"))
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(kernel, schema)


def within(rows: DataFrame, kernel, schema: str, times: int = 1) -> DataFrame:
    """kernel(rows of two blocks, whether each is of the second) for every pair of blocks and (all False) every block of rows, which have a column h to deal them by.

    Each row goes to as many tasks as there are blocks. A kernel that takes
    ``times`` as many rows gets larger blocks once there are many.
    """
    n = _blocks(rows)
    n = max(-(-n // times), min(n, 8))
    dealt = rows.withColumn("_own", F.pmod("h", F.lit(n)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = dealt.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))

    def task(g: pd.DataFrame) -> pd.DataFrame:
        second = (g["_own"] != g["_low"]).to_numpy()
        met = second.any() or (g["_low"] == g["_high"]).all()  # else the second block has no rows
        return kernel(g if met else g[:0], second if met else second[:0])

    return spread(pairs, "_low", "_high").groupBy("_low", "_high").applyInPandas(task, schema)
