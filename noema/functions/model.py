"""Calls of a model on batches of texts, with a rule in place of every answer that doesn't come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of one call.
BATCH = 64


def answered(df: DataFrame, asked: str, out: str, fallback: Column, call: Callable[[list[str]], list[str | None]] | None = None, batch: int = BATCH) -> DataFrame:
    """df with the text column ``out``: what ``call`` answers to the texts of the column ``asked``, else ``fallback``.

    ``call`` takes a list of texts and returns a list as long, with None where it
    has no answer; a batch whose call fails has none. It runs on the executors,
    once for a batch, and must be safe to run again. Without ``call`` the rule
    decides alone, inside the plan. ``out_by`` says which it was.
    """
    by = f"{out}_by"
    if call is None:
        return df.withColumn(out, fallback).withColumn(by, F.lit("rule"))
    kind = T.StructType([*df.schema.fields, T.StructField("__answer", T.StringType())])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[str | None] = []
            texts = frame[asked].tolist()
            for at in range(0, len(texts), batch):
                some = ["" if t is None else t for t in texts[at : at + batch]]
                try:
                    got = call(some)
                except Exception:  # noqa: BLE001 - any failure of a model means no answer
                    got = None
                found += got if got is not None and len(got) == len(some) else [None] * len(some)
            yield frame.assign(__answer=found)

    told = df.mapInPandas(ask, kind)
    return told.withColumn(by, F.when(F.col("__answer").isNotNull(), "model").otherwise("rule")).withColumn(out, F.coalesce("__answer", fallback)).drop("__answer")


def calibrated(score: Column, points: list[tuple[float, float]] | None = None) -> Column:
    """A score moved along the straight lines between ``points`` (score, what it was worth), clipped to 0 and 1; as it is without points."""
    if not points:
        return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    points = sorted(points)
    out = F.lit(float(points[-1][1]))
    for (a, x), (b, y) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        out = F.when(score <= b, F.lit(float(x)) + (score - a) * ((y - x) / (b - a) if b > a else 0.0)).otherwise(out)
    out = F.when(score <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))
