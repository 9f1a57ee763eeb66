"""Streams with state against what one pass over everything gives."""

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noema.operators.memory import KEY
from noema.sources import store
from noema.streaming import memory_state, registry

OPS = "event_id long, user_id long, memory_type string, memory_key int, value double, ts timestamp"
START = datetime(2024, 1, 1, 12)


def by_hand(ops, idle):
    """Items at the latest write, one write after the other."""
    held = {}
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    now = max(ms(o[5]) for o in ops)
    for _, *key, value, ts in sorted(ops, key=lambda o: (o[5], o[0])):
        t = ms(ts)
        weight, last = held.get(tuple(key), (None, None, None))[1:]
        if weight is not None:
            weight *= memory_state.RATE ** memory_state.midnights(last, t, idle)
        held[tuple(key)] = value, (1.0 if weight is None or weight < 0.1 else min(2.0, weight + 0.1)), t
    out = {k: (v, w * memory_state.RATE ** memory_state.midnights(t, now, idle)) for k, (v, w, t) in held.items()}
    return {k: (v, round(w, 6)) for k, (v, w) in out.items() if w >= 0.1}


def test_items_fade_are_forgotten_and_begin_anew(spark):
    days = [("a", 0), ("b", 0), ("a", 0), ("a", 1), ("c", 3), ("b", 5), ("a", 40), ("d", 58), ("b", 70), ("c", 90), ("a", 91)]
    ops = [(n, 1, "t", ord(k), float(n), START + timedelta(days=day, minutes=n)) for n, (k, day) in enumerate(days)]
    root = f"{store.folder(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(0, len(ops), 3):
        spark.createDataFrame(ops[k : k + 3], OPS).coalesce(1).write.mode("append").parquet(f"{root}/ops")
    given = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{root}/ops")
    table = store.Table(spark, f"{root}/items", KEY, memory_state.SCHEMA)
    got = memory_state.run(spark, given, table, f"{root}/checkpoint", 1.5)
    want = by_hand(ops, 1.5)
    assert {(r.user_id, r.memory_type, r.memory_key): (r.value, round(r.weight, 6)) for r in got.collect()} == want
    assert want[1, "t", ord("a")][1] < 1.2 and (1, "t", ord("d")) in want


def test_the_moment_an_item_is_forgotten():
    for weight in (0.1, 0.11, 1.0, 1.05, 2.0):
        last = 1_700_000_000_000
        at = memory_state.forgotten_at(weight, last, 2)
        left = lambda t, w=weight: w * memory_state.RATE ** memory_state.midnights(last, t, 2)
        assert left(at) < 0.1 <= left(at - 1) and at % memory_state.DAY == 0


def test_a_replayed_batch_counts_once(spark):
    held = registry.table(spark, f"{store.folder(spark)}/registry-{uuid.uuid4().hex}")
    batch = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    assert registry.merge(held, batch((5, "x"), (6, "x"), (7, None)), 0)
    assert registry.merge(held, batch((2, "x"), (3, "y")), 1)
    assert not registry.merge(held, batch((2, "x"), (3, "y")), 1)
    assert not registry.merge(held, batch((5, "x"), (6, "x")), 0)
    assert registry.merge(held, batch((9, "y")), 2)
    got = held.load().select(F.length("hash"), "version", "first_id", "batch", F.size("vector")).collect()
    assert sorted(map(tuple, got)) == [(64, 2, 3, 2, 64), (64, 3, 2, 1, 64)]


def test_a_batch_of_writes_that_comes_again_or_late_changes_nothing(spark):
    table = store.Table(spark, f"{store.folder(spark)}/items-{uuid.uuid4().hex}", KEY, memory_state.SCHEMA)
    batch = lambda *rows: spark.createDataFrame([(n, 1, "t", key, float(n), START + timedelta(days=day)) for n, key, day in rows], OPS)
    first = batch((1, 7, 0), (2, None, 0), (3, 7, 1), (4, None, 1))
    assert memory_state.merge(table, first, 0, 2)
    assert not memory_state.merge(table, first, 0, 2)
    assert not memory_state.merge(table, batch((5, 7, 0)), 1, 2)  # too late
    got = {r.memory_key: (r.value, round(r.weight, 6)) for r in table.load().collect()}
    assert got == {7: (3.0, 1.1), None: (4.0, 1.1)}
    assert memory_state.merge(table, batch((6, 8, 400)), 2, 2)
    assert [r.memory_key for r in table.load().collect()] == [8]
