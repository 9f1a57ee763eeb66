"""Memory items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["user_id", "memory_type", "memory_key"]


def upserts(ops: DataFrame) -> DataFrame:
    """The item each key ends as: newest value; weight 1, 0.1 more for each repeat, 2 at most."""
    return ops.groupBy(*KEY).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.round(F.least(F.lit(2.0), 1 + 0.1 * (F.count("*") - 1)), 6).alias("weight"), F.max("ts").alias("last_accessed"))


def decayed(items: DataFrame, as_of: str, rounds: int = 1, idle_days: int = 30) -> DataFrame:
    """Weights after ``rounds`` decays of items idle since longer; items under 0.1 are gone."""
    idle = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_accessed").cast("timestamp"))) > idle_days * 86_400
    w = F.when(idle & (F.col("weight") > 0.01), F.col("weight") * F.pow(F.lit(0.95), F.lit(rounds))).otherwise(F.col("weight"))
    return items.withColumn("weight", F.round(w, 6)).where("weight >= 0.1")


def conversations(turns: DataFrame) -> DataFrame:
    """Turns, first and last turn and title (first 30 characters of the first user turn) of each conversation."""
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 30)), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), title.alias("title"))


def feedback(events: DataFrame, span: int = 86_400) -> DataFrame:
    """alpha and beta of each user after all its events (user_id, ts, event_id, kind: positive, negative, correct, other) in order; from 2 and 2.

    Positive and correct add 1 to alpha, negative adds 1 to beta, correct takes
    half from beta, down to 1. What a run of events does to beta is always
    ``greatest(low, beta + sum)``, so each span of time is folded on its own and
    only the spans' pairs meet: a user's whole history is never one array.
    """
    a = F.count_if(F.col("kind").isin("positive", "correct"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))), lambda x: F.struct(F.when(x["kind"] == "negative", 1.0).when(x["kind"] == "correct", -0.5).otherwise(0.0).alias("sum"), F.when(x["kind"] == "correct", 1.0).otherwise(float("-inf")).alias("low")))

    def then(one, two):
        return F.struct((one["sum"] + two["sum"]).alias("sum"), F.greatest(one["low"] + two["sum"], two["low"]).alias("low"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("low"))
    part = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span)
    spans = events.groupBy("user_id", part.alias("span")).agg(a.alias("a"), F.aggregate(steps, start, then).alias("f"))
    whole = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("span", "f"))), lambda x: x["f"]), start, then)
    done = spans.groupBy("user_id").agg(F.sum("a").alias("a"), whole.alias("f"))
    return done.select("user_id", (2.0 + F.col("a")).alias("alpha"), F.greatest(F.col("f.low"), 2.0 + F.col("f.sum")).alias("beta"))
