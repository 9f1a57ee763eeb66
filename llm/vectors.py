"""What the two vector searches share: usable rows, blocks of queries and the merge of shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block, about; one of each meets in a task.
SHARD = 4096
QUERIES = 4096


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and v, the vector in double precision, of rows whose components are all there and finite; all-zero vectors only with ``zero``."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def of_equal_ones(rows: DataFrame, k: int) -> DataFrame:
    """rows (vec_id, v, ...) without those that no ranking of k can hold: of equal vectors, which always tie, the k + 1 smallest ids (one may be the query's own) stay. Spark cuts the groups before it shuffles them."""
    equal = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    return rows.withColumn("nth", F.dense_rank().over(equal)).where(F.col("nth") <= k + 1).drop("nth")


def block_of(vec_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vec_id), F.lit(1)), F.lit(blocks)).cast("int")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of what the shards found; few rows a query and shard, cut before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def threshold_of(best: DataFrame, k: int) -> DataFrame:
    """query_id, held: the scores of ``best_of``, highest first."""
    return best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("held"))
