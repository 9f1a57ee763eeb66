"""Memory items as the state of a stream: a value and a weight for each key, which fade and are forgotten.

Each write sets the value; the weight begins at 1 and gains 0.1 with each further
one, up to 2. Every midnight takes a twentieth from the weight of an item that
nobody wrote for longer than ``idle`` days; under 0.1 the item is gone. Midnights
are event time. What an item weighs at any time follows from its weight and the
time of its last write, so between writes nothing needs to be touched.

The state is a versioned table. Each batch of the stream is folded into it by one
grouping of items and writes by their key, and what the batch's newest write shows
to be gone is left out. Every row remembers the last batch that changed it, so a
batch that comes again changes nothing. A key's writes of one batch are one array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators.memory import KEY
from noema.sources.store import Table

DAY = 86_400_000
RATE, FORGOTTEN = 0.95, 0.1
SCHEMA = "user_id long, memory_type string, memory_key int, value double, weight double, last long, at long, batch long"


def midnights(last: int, now: int, idle_days: float) -> int:
    """Midnights after ``idle_days`` from ``last`` up to ``now``; times in milliseconds."""
    return max(0, now // DAY - (last + int(idle_days * DAY)) // DAY)


def forgotten_at(weight: float, last: int, idle_days: float) -> int:
    """The midnight that makes an item of that weight, last written then, lighter than ``FORGOTTEN``."""
    nights = max(1, math.floor(math.log(FORGOTTEN / weight) / math.log(RATE)))
    while weight * RATE**nights >= FORGOTTEN:
        nights += 1
    return ((last + int(idle_days * DAY)) // DAY + nights) * DAY


def merge(table: Table, batch: DataFrame, n: int, idle_days: float) -> bool:
    """Folds batch ``n`` of writes (KEY, value, ts, event_id) into the items; False if it has been before or is empty. Writes from before the newest one of earlier batches come too late."""
    held = table.load()
    top = held.agg(F.max("last").alias("last"), F.max("batch").alias("batch")).first()
    if top.batch is not None and top.batch >= n:
        return False
    # no state is held between batches but the table; one shuffle brings a key's writes to its item
    write = F.struct(F.unix_millis("ts").alias("ms"), "event_id", "value")
    rows = batch.select(*KEY, write.alias("write"))
    rows = rows if top.last is None else rows.where(F.col("write.ms") >= top.last)
    now = rows.agg(F.max("write.ms")).first()[0]
    if now is None:
        return False
    both = held.select(*KEY, "value", "weight", "last", "batch").unionByName(rows, allowMissingColumns=True)
    met = both.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("value", "weight", "last", "batch")], F.array_sort(F.collect_list("write")).alias("writes"))

    def step(item, x):
        left = item["weight"] * F.pow(F.lit(RATE), _nights(item["last"], x["ms"], idle_days))
        return F.struct(F.when(left.isNull() | (left < FORGOTTEN), 1.0).otherwise(F.least(F.lit(2.0), left + 0.1)).alias("weight"), x["ms"].alias("last"))

    item, new = F.aggregate("writes", F.struct("weight", "last"), step), F.size("writes") > 0
    value = F.when(new, F.element_at("writes", -1)["value"]).otherwise(F.col("value"))
    folded = met.select(*KEY, value.alias("value"), item.alias("item"), F.when(new, F.lit(n)).otherwise(F.col("batch")).cast("long").alias("batch"))
    items = folded.select(*KEY, "value", "item.weight", "item.last", F.col("item.last").alias("at"), "batch")
    # what is gone by now leaves nothing behind
    table.save(items.where(F.col("weight") * F.pow(F.lit(RATE), _nights(F.col("last"), F.lit(now), idle_days)) >= FORGOTTEN))
    return True


def _nights(last: Column, now: Column, idle_days: float) -> Column:
    return F.greatest(F.lit(0), F.floor(now / DAY) - F.floor((last + int(idle_days * DAY)) / DAY))


def faded(items: DataFrame, now: int, idle_days: float) -> DataFrame:
    """The items with what they weigh at ``now`` (milliseconds), without those that are gone."""
    nights = _nights(F.col("last"), F.lit(now), idle_days)
    return items.withColumn("weight", F.col("weight") * F.pow(F.lit(RATE), nights)).where(F.col("weight") >= FORGOTTEN)


def run(spark: SparkSession, ops: DataFrame, table: Table, checkpoint: str, idle_days: float) -> DataFrame:
    """Runs the stream over what is there and gives the items as they are at its latest write."""
    put = lambda batch, n: merge(table, batch, n, idle_days) and None
    ops.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    now = table.load().agg(F.max("last")).first()[0]
    return faded(table.load(), now or 0, idle_days)
