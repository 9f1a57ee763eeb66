"""Sequences scanned in pieces against plain loops, with nine tenths of the rows in one key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noema.operators import scan, timeline


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(12)
    rows = [(None if r.random() < 0.02 else 1 if r.random() < 0.9 else r.randrange(2, 30), float(r.randrange(4000)), n, r.choice([None, r.randrange(50)])) for n in range(6000)]
    return rows, spark.createDataFrame(rows, "user long, t double, n long, v long").repartition(8).cache()


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(rows):
    keys = defaultdict(list)
    for user, t, n, v in sorted(rows, key=lambda x: (x[1], x[2])):
        keys[user].append((n, t, v))
    return keys


def test_a_hot_key_lies_in_many_pieces(hot):
    _, df = hot
    held = scan.pieces(df, "user", "t", "n").groupBy("user", "piece").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    mine = sorted((r.piece, r.a, r.b, r.n) for r in held.where("user = 1").collect())
    assert len(mine) >= 6 and max(x[3] for x in mine) < 2000
    assert all(p[2] <= q[1] for p, q in zip(mine, mine[1:], strict=False))


def test_last_known(hot):
    rows, df = hot
    want = {}
    for keys in in_order(rows).values():
        known = None
        for n, _, v in keys:
            known = v if v is not None else known
            want[n] = known
    assert {r.n: r.known for r in scan.last_known(df, "user", "v", "t", "n").collect()} == want


def test_neighbours_and_running(hot):
    rows, df = hot
    earlier, total = {}, {}
    for keys in in_order(rows).values():
        seen, so_far = None, None
        for n, _, v in keys:
            earlier[n] = seen
            seen = v
            so_far = v if so_far is None else so_far if v is None else so_far + v
            total[n] = so_far
    assert {r.n: r.earlier for r in scan.neighbours(df, "user", "v", "t", "n").collect()} == earlier
    got = {r.n: r.total for r in scan.running(df.na.fill(0, "v"), "user", "v", "t", "n").collect()}
    assert got == {n: x or 0 for n, x in total.items()}


def test_sessions_of_a_hot_user(hot):
    rows, df = hot
    want = []
    for user, keys in in_order(rows).items():
        runs = []
        for _, t, _ in keys:
            if runs and (t - runs[-1][1]) <= 180:
                runs[-1][1], runs[-1][2] = t, runs[-1][2] + 1
            else:
                runs.append([t, t, 1])
        want += [(user, k + 1, *x) for k, x in enumerate(runs)]
    given = df.withColumn("ts", F.timestamp_seconds("t"))
    got = timeline.sessions(given, "user", "ts", 3).select("user", "session", F.unix_timestamp("start").cast("double"), F.unix_timestamp("end").cast("double"), "n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_as_of_on_a_hot_key(spark, hot):
    rows, df = hot
    bounds = df.where("n % 10 = 0").select("user", F.col("t").alias("at"))
    points = df.where("n % 10 <> 0").select("user", "t", F.col("n").alias("point"))
    by = defaultdict(list)
    for user, t, n, _ in rows:
        if n % 10 == 0:
            by[user].append(t)
    want = {n: max([x for x in by[user] if x <= t], default=min(by[user], default=None)) for user, t, n, _ in rows if n % 10}
    assert {r.point: r.bound for r in timeline.as_of(points, bounds, "user").collect()} == want
