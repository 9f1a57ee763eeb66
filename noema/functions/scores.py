"""Numeric expressions: vectors, confidence, decay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hash_vector(text: Column, dims: int = 1024) -> Column:
    """A vector that only equal texts share: the 32 SHA-256 bytes over 255, zeros after them, of length 1."""
    squares = lambda head: F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x)
    unit = _once(digest_vector(F.sha2(text, 256)), lambda head: _once(squares(head), lambda n: F.transform(head, lambda x: F.when(n > 0, x / F.sqrt(n)).otherwise(x))))
    return F.concat(unit, F.array_repeat(F.lit(0.0), max(0, dims - 32)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once, not at each place and for each element where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest_vector(digest: Column) -> Column:
    """The 32 bytes of a SHA-256 in hex as numbers from 0 to 1."""
    byte = lambda d, i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255
    return _once(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(d, i)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decay(days: Column) -> Column:
    """exp(-0.005 days), days no less than 0; 1 for null."""
    return F.coalesce(F.exp(-0.005 * F.greatest(days, F.lit(0))), F.lit(1.0))


def feedback_mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def combined(model: Column, source: Column, graph: Column, alpha: Column, beta: Column, days: Column) -> Column:
    """The weighted confidence, averaged with feedback where there is any, decayed, 4 places, 0.1 to 1."""
    base = 0.4 * model + 0.3 * source + 0.3 * graph
    with_feedback = F.when((alpha > 2) | (beta > 2), (base + feedback_mean(alpha, beta)) / 2).otherwise(base)
    # what is half way between two places goes up, whatever the last bits are
    return clip(F.round(with_feedback * decay(days) + 1e-9, 4), 0.1, 1.0)


def updated(kind: Column, alpha: Column, beta: Column) -> tuple[Column, Column]:
    """alpha and beta after one positive, negative or correct event; others change nothing."""
    up = F.when(kind.isin("positive", "correct"), alpha + 1).otherwise(alpha)
    return up, F.when(kind == "negative", beta + 1).when(kind == "correct", F.greatest(F.lit(1.0), beta - 0.5)).otherwise(beta)


def after_feedback(kind: Column, model: Column, source: Column, graph: Column, alpha: Column, beta: Column, days: Column) -> Column:
    """The combined confidence once alpha and beta have taken an event in; a negative one contradicts besides, for a fifth less."""
    conf = combined(model, source, graph, *updated(kind, alpha, beta), days)
    return F.when(kind == "negative", clip(conf * 0.8, 0.1, 1.0)).otherwise(conf)


def source_trust(n: Column, corrections: Column, kind: Column, bonus: dict[str, float]) -> Column:
    """A half, up to .15 for many facts, by kind of source, less for corrections; 0.2 to 1."""
    extra = F.lit(0.0)
    for k, v in bonus.items():
        extra = F.when(kind == k, v).otherwise(extra)
    return clip(0.5 + F.least(F.lit(0.15), 0.01 * n) + extra - 0.2 * F.least(corrections, F.lit(5)) * 0.04, 0.2, 1.0)


def model_confidence(raw: Column, samples: Column, consistency: Column) -> Column:
    """A model's raw score, with several samples 0.7 of it and 0.3 of how far they agree; 0.1 to 1."""
    return clip(F.when(samples > 1, 0.7 * raw + 0.3 * consistency).otherwise(raw), 0.1, 1.0)


def source_quality(source: Column, fact: Column, interactions: Column, base: dict[str, float], authority: list[str], subjective: list[str]) -> Column:
    from noema.functions.text import count_of

    start = F.lit(0.5)
    for k, v in base.items():
        start = F.when(source == k, v).otherwise(start)
    q = start - 0.05 * count_of(fact, subjective) + 0.08 * count_of(fact, authority) + F.when(fact.rlike("[0-9]"), 0.05).otherwise(0.0) + F.least(F.lit(0.15), 0.02 * interactions)
    return clip(q, 0.2, 1.0)


def fold_feedback(events: Column) -> Column:
    """alpha and beta after positive, negative and correct events in order; from 2 and 2."""
    def step(s: Column, e: Column) -> Column:
        a = F.when(e.isin("positive", "correct"), s["a"] + 1).otherwise(s["a"])
        b = F.when(e == "negative", s["b"] + 1).when(e == "correct", F.greatest(F.lit(1.0), s["b"] - 0.5)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(events, F.struct(F.lit(2.0).alias("a"), F.lit(2.0).alias("b")), step)
