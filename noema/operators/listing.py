"""Filters, tiers, sorting and pages of knowledge points."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(rules: dict) -> Column:
    """All the rules given: category, text, source_contains, source, status, min, max, since, until, tier, tag (in category or fact), tags (one of them), days_within (days, as of)."""
    made = {
        "category": lambda v: F.col("category").isin(v if isinstance(v, list) else [v]),
        "text": lambda v: F.lower("fact").contains(v.lower()),
        "source_contains": lambda v: F.col("source").contains(v),
        "source": lambda v: F.col("source") == v,
        "status": lambda v: F.col("status") == v,
        "min": lambda v: F.coalesce("confidence", F.lit(0.0)) >= v,
        "max": lambda v: F.coalesce("confidence", F.lit(1.0)) <= v,
        "since": lambda v: F.col("created_on") >= F.lit(v).cast("date"),
        "until": lambda v: F.col("created_on") <= F.lit(v).cast("date"),
        "tier": lambda v: tier(F.col("confidence")) == v,
        "tag": lambda v: F.col("category").contains(v) | F.col("fact").contains(v),
        "tags": lambda v: F.arrays_overlap("tags", F.array(*map(F.lit, v))),
        "days_within": lambda v: F.col("created_on") >= F.date_sub(F.lit(v[1]).cast("date"), v[0]),
    }
    out = F.lit(True)
    for name, value in rules.items():
        out = out & made[name](value)
    return out


def tier(conf: Column) -> Column:
    return F.when(conf >= 0.7, "high").when(conf >= 0.4, "medium").otherwise("low")


def display_tier(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.6, "good").when(conf >= 0.4, "fair").otherwise("critical")


def sort_key() -> Column:
    """Confidence, with 0 and null as 0.5."""
    c = F.col("confidence")
    return F.when(c.isNull() | (c == 0), 0.5).otherwise(c)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def cursor(created: str, id_: int) -> str:
    return base64.b64encode(f"{created}|{id_}|0".encode()).decode()


def opened(token: str) -> list | None:
    """The key that a cursor holds: the day as text and the id; None for what is no cursor."""
    try:
        created, id_, _ = base64.b64decode(token).decode().split("|")
        return [created, int(id_)]
    except ValueError:
        return None


def _place(token: str) -> tuple[Column, int] | None:
    at = opened(token)
    return None if at is None else (F.lit(at[0]).cast("date"), at[1])


def after(rows: DataFrame, token: str, size: int) -> DataFrame:
    """The rows next to the cursor, newest first: a filter that reaches the scan, not an offset. An unknown cursor has an empty page."""
    at = _place(token)
    if at is None:
        return rows.limit(0)
    older = (F.col("created_on") < at[0]) | ((F.col("created_on") == at[0]) & (F.col("id") < at[1]))
    return rows.where(older).orderBy(F.desc("created_on"), F.desc("id")).limit(size)


def before(rows: DataFrame, token: str, size: int) -> DataFrame:
    """The rows just before the cursor in that order, nearest first."""
    at = _place(token)
    if at is None:
        return rows.limit(0)
    newer = (F.col("created_on") > at[0]) | ((F.col("created_on") == at[0]) & (F.col("id") > at[1]))
    return rows.where(newer).orderBy("created_on", "id").limit(size)
