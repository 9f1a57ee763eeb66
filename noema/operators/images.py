"""Statistics of pictures and what kind they seem to be, from their pixels alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = ("brightness", "dark_100", "dark_120", "spread", "most_spread", "max_0", "max_1", "max_2", "aspect")
_KIND = T.StructType([T.StructField(n, T.DoubleType()) for n in _NUMBERS])


def numbers(data: bytes, width: int, height: int, channels: int) -> tuple:
    """Mean brightness, shares of pixels darker than 100 and 120, sum and highest of the channels' deviations, their highest values, width over height."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3].astype(float)
    gray, dev, top = a.mean(axis=2), a.reshape(-1, a.shape[2]).std(axis=0), a.reshape(-1, a.shape[2]).max(axis=0)
    dev, top = (np.resize(x, 3) for x in (dev, top))  # one channel stands for three
    return (gray.mean(), (gray < 100).mean(), (gray < 120).mean(), dev.sum(), dev.max(), *top, width / height)


@F.pandas_udf(_KIND)
def _numbers(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([numbers(*x) for x in zip(data, width, height, channels, strict=True)], columns=_NUMBERS)


def statistics(data: Column, width: Column, height: Column, channels: Column) -> Column:
    """The numbers of a picture: bytes row by row, channels together, as Spark's image source has them."""
    return _numbers(data, width, height, channels)


# The thresholds of the kinds.
def category(s: Column) -> Column:
    """text_dense, document, screenshot, diagram, chart or photo."""
    dark, spread = s["dark_120"], s["spread"]
    return (
        F.when(dark > 0.12, "text_dense")
        .when((dark > 0.05) & (s["aspect"] < 0.78), "document")
        .when((dark > 0.04) & (spread > 100), "screenshot")
        .when((dark > 0.02) & (spread < 60), "diagram")
        .when(spread > 150, "photo")
        .when((spread > 80) & (spread < 150), "chart")
        .otherwise("photo")
    )


def visual_type(s: Column) -> Column:
    """low_contrast, text, mixed, colourful or graphic, of a frame or page."""
    dark = s["dark_100"]
    return F.when(s["most_spread"] < 15, "low_contrast").when(dark > 0.08, "text").when(dark > 0.03, "mixed").when(s["most_spread"] > 60, "colourful").otherwise("graphic")
