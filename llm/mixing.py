"""Operator 3: mixing sources to target weights by subset-sum budget fitting.

Each source gets a target size. Whole passes over the source are taken while
they fit; what is left of the target is a budget to be met by a subset of the
source's documents. The subset is fitted on counts of documents by exact
length: each length first gives its seeded share, and the last stretch is a
bounded knapsack, solved exactly by dynamic programming over the reachable
sums. Then the documents of each length are drawn by seeded hash. Only the
counts by length meet in one place, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import n_words, settle

#: Part of all sizes that the mix has.
SHARE = 1.5
#: Passes over a source, at most.
REPEATS = 2
WEIGHTS = (3, 1, 2)
SEED = 29
#: Largest remainder that is fitted by dynamic programming, unless one length is longer.
REST = 1 << 16
#: Hash ranges of a length's documents; only the one in which a draw ends is ranked.
LANES = 256
#: Sources up to which their plan is broadcast; more are joined by hash.
SENT = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = REPEATS) -> list[float]:
    """What each source gets of ``share`` times all sizes: by weight, no more than ``most`` times its size, what is over by weight among the others."""
    budget, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = {k for k, s in enumerate(sizes) if s > 0}
    while open_:
        total = sum(weights[k] for k in sorted(open_))
        full = {k for k in open_ if budget * weights[k] / total > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = budget * weights[k] / total
            break
        for k in full:
            out[k] = float(most * sizes[k])
        budget -= sum(out[k] for k in sorted(full))
        open_ -= full
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int = REST) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum to ``budget``, or come as near below it as can be."""
    order = np.argsort(lengths)
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return counts.copy()
    take = (count * budget) // max(1, total) if total < 1 << 40 else np.array([int(c) * budget // total for c in count.tolist()])
    left = budget - int((length * take).sum())
    rest = max(rest, int(length.max(initial=0)) * 2)
    for k in range(len(length) - 1, -1, -1):  # what the shares' fractions leave, down to what is fitted exactly
        if left <= rest:
            break
        more = min(int(count[k] - take[k]), (left - rest) // int(length[k]) if length[k] else 0)
        take[k] += more
        left -= more * int(length[k])
    room = count - take
    # sums[s]: the index of the length whose use first reached s
    by = np.full(left + 1, -1, np.int32)
    used = np.zeros(left + 1, np.int64)
    by[0] = len(length)
    for k in np.argsort(-np.minimum(room, left // np.maximum(length, 1)), kind="stable"):
        size, most = int(length[k]), int(room[k])
        if by[left] >= 0:
            break
        if size == 0 or size > left or most == 0:
            continue
        front, n = np.flatnonzero(by >= 0), 0
        while len(front) and n < most:
            n += 1
            front = front + size
            front = front[front <= left]
            front = front[by[front] < 0]
            by[front], used[front] = k, n
    s = int(np.flatnonzero(by >= 0).max())
    while s:
        k, n = int(by[s]), int(used[s])
        take[k] += n
        s -= n * int(length[k])
    out = np.empty_like(counts)
    out[order] = take
    return out


def mix(docs: DataFrame, share: float = SHARE, most: int = REPEATS, weights: tuple = WEIGHTS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs (doc_id, text, source) with what the mix takes of it.

    Returns doc_id, size (words), source_size, target (of its source) and taken
    (words, repeats counted: a document is taken 0 to ``most`` times, always
    whole; of rows that tie with the last one drawn, which are alike in id and
    text, only as many are taken as are still wanted). Sources sort by code point, null last, and weigh ``weights`` in
    turn. Null and empty texts have size 0 and nothing is taken of them. Rows
    of one id, or of none, count one by one in all sums and draw by their texts.
    An empty table gives no rows. ``carry`` names columns to return besides (those of
    other names than the five). The sources' names and sizes go through the driver,
    their documents don't.
    """
    more = [c for c in carry if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    draw = F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id").cast("long"), "text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), draw.alias("draw"), *[F.col(c).alias(f"_of_{c}") for c in more])
    rows = settle(named.select("doc_id", "size", "source", "draw"))
    counts = settle(rows.groupBy("source", "size").count())
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("total")).collect()
    by_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.total) for r in by_source]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    spark = docs.sparkSession
    plan = pd.DataFrame({"source": [r.source for r in by_source], "source_size": sizes, "target": goal})
    plan["passes"] = [min(most, int(t // s)) if s else 0 for t, s in zip(goal, sizes, strict=True)]
    plan["budget"] = [int(round(t - p * s)) for t, s, p in zip(goal, sizes, plan.passes, strict=True)]
    kind = "source string, source_size long, target double, passes long, budget long"
    sent = F.broadcast if len(by_source) <= SENT else lambda df: df
    plan_rows = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in plan.astype(object).itertuples(index=False)], kind)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        got = pd.concat(parts, ignore_index=True)
        for _, g in got.groupby("source", dropna=False, sort=False):
            g = g.assign(take=fit_lengths(g["size"].to_numpy(), g["count"].to_numpy(), int(g["budget"].iloc[0])))
            yield g[["source", "size", "take"]]

    lengths = counts.join(sent(plan_rows.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "count", "budget")
    take = settle(lengths.repartition("source").mapInPandas(fit, "source string, size long, take long"))
    lane = F.shiftrightunsigned("draw", 56).cast("int")
    ahead = Window.partitionBy("source", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = rows.groupBy("source", "size", lane.alias("lane")).count().withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    take = take.select(F.col("source").alias("s"), F.col("size").alias("z"), "take")
    wanted = F.least("count", F.greatest(F.col("take") - F.col("ahead"), F.lit(0))).alias("wanted")
    lanes = settle(lanes.join(take, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("s", "z", F.col("lane").alias("l"), wanted, "count"))
    meets = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("lane") == F.col("l"))
    # where a draw ends inside a lane, its last document
    among = Window.partitionBy("source", "size", "lane")
    ranked, first, after = F.row_number().over(among.orderBy("draw", "doc_id")), F.rank().over(among.orderBy("draw")), F.lead("draw").over(among.orderBy("draw", "doc_id"))
    edge = rows.withColumn("lane", lane).join(lanes.where("wanted > 0 and wanted < count"), meets)
    # how many are still wanted of those that tie with it, and whether there are more
    edge = edge.withColumn("rank", ranked).withColumn("first", first).withColumn("after", after).where("rank = wanted")
    last = settle(edge.select(F.col("s").alias("es"), F.col("z").alias("ez"), F.col("l").alias("el"), F.col("draw").alias("last"), (F.col("wanted") - F.col("first") + 1).alias("still"), F.coalesce(F.col("after") == F.col("draw"), F.lit(False)).alias("over")))
    ties = not last.where("over").isEmpty()
    lanes = lanes.join(last, F.col("s").eqNullSafe(F.col("es")) & (F.col("z") == F.col("ez")) & (F.col("l") == F.col("el")), "left").select("s", "z", "l", "last", "still", "over", (F.col("wanted") == F.col("count")).alias("all"))
    again = named if more else rows
    both = again.withColumn("lane", lane).join(lanes, meets).withColumn("more", (F.col("all") | F.coalesce(F.col("draw") <= F.col("last"), F.lit(False))).cast("long")).drop("s", "z", "l")
    if ties:
        tied = F.coalesce(F.col("over") & (F.col("draw") == F.col("last")), F.lit(False))
        nth = F.row_number().over(among.orderBy("draw", "doc_id"))
        both = both.where(~tied).unionByName(both.where(tied).withColumn("more", (nth <= F.col("still")).cast("long")))
    out = both.join(sent(plan_rows.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"), "source", *[F.col(f"_of_{c}").alias(c) for c in more])
