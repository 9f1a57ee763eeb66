"""Operator 5: k-d tree partitioning into shards of nearly equal bytes.

A node of the tree holds units in a box of metadata dimensions. It is split at
the weighted median of the dimension along which it is widest (relative to the
whole table), until each leaf has the target bytes. A node for an uneven number
of leaves is split at the matching quantile. All nodes of a level are split at
once: their medians come from histograms of byte weights that are refined where
the median falls, so no node's rows are ever sorted or gathered. Where single
texts are large beside a shard, a few of them then move from the heaviest leaves
to the lightest.

A unit is all rows of one text, so copies stay together; a text whose copies
weigh more than ``1 / LOOSE`` of a leaf is a hot group, and each of its rows
becomes a unit of its own. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import n_bytes, settle, unsettle

#: A text with more than this part of a leaf's bytes is not kept together.
LOOSE = 10
#: Bins of a histogram, and the part of a leaf's bytes that a cut may be off.
BINS = 512
CLOSE = 1 / 400
#: Rows of a shard that are numbered together, about; groups of a shard at least; and groups of all shards up to which their starts are broadcast.
LANE = 50_000
LANES = 64
SENT = 500_000

#: What a shard's bytes may be off before units move between shards, and how often they do.
EVEN = 1 / 100
ROUNDS = 12

DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
_TOP = 1 << 31


def _cuts(units: DataFrame, nodes: dict[int, tuple], total: float, leaves: int) -> dict[int, int]:
    """For each node (dimension, share of its weight that goes left) the key at which it is cut."""
    leaf = total / leaves
    left = {n: share * weight for n, (_, share, weight, *_) in nodes.items()}
    span = {n: (low, high) for n, (_, _, _, low, high) in nodes.items()}
    below = dict.fromkeys(nodes, 0.0)
    cut: dict[int, int] = {}
    while left.keys() - cut.keys():
        open_ = sorted(left.keys() - cut.keys())
        frame = F.create_map(*[x for n in open_ for x in (F.lit(n), F.struct(F.lit(span[n][0]).cast("long").alias("low"), F.lit(max(1, -(-(span[n][1] - span[n][0] + 1) // BINS))).cast("long").alias("step"), F.lit(span[n][1]).cast("long").alias("high")))])
        inside = units.where(F.col("node").isin(open_)).withColumn("f", frame[F.col("node")]).where("key >= f.low and key <= f.high")
        bins = inside.groupBy("node", F.expr("(key - f.low) div f.step").alias("bin")).agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        by: dict[int, list] = {n: [] for n in open_}
        for r in bins:
            by[r.node].append(r)
        for n in open_:
            for r in sorted(by[n], key=lambda r: r.bin):
                if below[n] + r.weight >= left[n]:
                    if r.low == r.high or r.weight <= CLOSE * leaf:
                        # the nearer side of what can't or needn't be told apart
                        cut[n] = r.high + 1 if left[n] - below[n] > below[n] + r.weight - left[n] else r.low
                    else:
                        span[n] = (r.low, r.high)
                    break
                below[n] += r.weight
            else:
                cut[n] = (by[n][-1].high if by[n] else span[n][1]) + 1
    return cut


def _moves(units: DataFrame, shards: int, leaf: float, even: float) -> dict[int, int]:
    """Which units (unit, weight, shard) go to which other shard, where few large ones leave shards uneven.

    The heaviest shard is paired with the lightest, the next with the next, and
    from round to round with the one after. Of each pair a unit of the heavier shard moves, or changes places with one of
    the lighter: those whose difference is nearest to half of what parts the
    shards, so that neither ends above where the heavier one was. Only units of a
    quarter of ``even`` and more are looked at, of which a shard holds a bounded
    number, and ``shards`` * ``ROUNDS`` at most move. Even shards need no round.
    """
    load = dict.fromkeys(range(shards), 0.0) | {r.shard: r.weight for r in units.groupBy("shard").agg(F.sum("weight").alias("weight")).collect()}
    large = units.where(F.col("weight") >= even * leaf / 4)
    moved: dict[int, int] = {}
    for turn in range(ROUNDS):
        order = sorted(load, key=lambda k: (load[k], k))
        light = order[: shards // 2]
        light = light[turn % max(1, len(light)) :] + light[: turn % max(1, len(light))]
        pairs = {high: low for low, high in zip(light, reversed(order), strict=False) if max(load[high] - leaf, leaf - load[low]) > even * leaf}
        if not pairs:
            break
        half = {high: (load[high] - load[low]) / 2 for high, low in pairs.items()}
        of = F.create_map(*[x for high, low in pairs.items() for k in (high, low) for x in (F.lit(k), F.lit(high))])
        now = F.coalesce(_held(moved)[F.col("unit")], "shard") if moved else F.col("shard")
        met = large.withColumn("at", now).withColumn("pair", of[F.col("at")]).where("pair is not null").withColumn("gives", F.col("at") == F.col("pair"))
        # where nothing comes back
        alone = units.sparkSession.range(1).select(F.lit(None).cast("long").alias("unit"), F.lit(0.0).alias("weight"), F.explode(F.array(*map(F.lit, pairs))).alias("pair"), F.lit(False).alias("gives"))
        met = met.select("unit", "weight", "pair", "gives").unionByName(alone).withColumn("key", F.when(F.col("gives"), F.col("weight")).otherwise(F.col("weight") + _held(half)[F.col("pair")]))
        w = Window.partitionBy("pair").orderBy("key", "gives", "unit")
        taken = F.when(~F.col("gives"), F.struct("key", "unit", "weight"))
        below = F.last(taken, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        above = F.first(taken, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        near = met.withColumn("below", below).withColumn("above", above).withColumn("back", F.explode(F.array("below", "above"))).where("gives and back is not null")
        near = near.withColumn("off", F.abs(F.col("key") - F.col("back.key"))).where(F.col("off") < _held(half)[F.col("pair")])
        found = near.groupBy("pair").agg(F.min(F.struct("off", "unit", "weight", "back")).alias("best")).collect()
        for r in found:
            high, low, best = r.pair, pairs[r.pair], r.best
            moved[best.unit] = low
            if best.back.unit is not None:
                moved[best.back.unit] = high
            load[high] -= best.weight - best.back.weight
            load[low] += best.weight - best.back.weight
    return moved


def _held(values: dict) -> F.Column:
    """A dictionary as a column."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v))])


def kd_shards(docs: DataFrame, shards: int = 40, lanes: int | None = None, even: float | None = EVEN) -> DataFrame:
    """Every row of docs (doc_id, text, lang, source) with its shard.

    Returns doc_id, size (UTF-8 bytes of the text, 0 for null, and 16),
    text_crc32 (0 for null), shard (0 to ``shards`` - 1) and slot (from 0 without
    gaps in each shard). Null texts count as one text; nulls in other columns
    stand before all values of their dimension. Where all rows are one value
    along every dimension, a hash of the text (of the row's number for hot groups)
    parts them, so repeated rows of any ids, or of none, are spread once their
    text is hot. Where texts are so large beside a shard that its bytes are off
    by more than ``even`` (None: they stay as the tree cut them), a few units move
    from heavy shards to light ones. An empty table has no rows.
    """
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (n_bytes(F.col("text")) + 16).alias("size"),
            F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("h"),
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.shiftrightunsigned(F.xxhash64("source"), 33), F.lit(0)).alias("d_source"),
            F.coalesce(F.shiftrightunsigned(F.xxhash64("lang"), 33), F.lit(0)).alias("d_lang"),
        )
    )
    same = ["h", "text_crc32", "size"]
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    lanes = lanes or max(LANES, -(-n // shards // LANE))
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # at most shards * LOOSE texts weigh that much, so this side is small by proof
    hot = rows.groupBy(*same).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > total / shards / LOOSE).select(*same, F.lit(True).alias("hot"))
    rows = settle(rows.join(F.broadcast(hot), same, "left").withColumn("unit", F.xxhash64("h", "text_crc32", "size", F.when(F.col("hot"), F.col("row")))))
    # the metadata of a unit: that of its row with the lowest id
    first = F.min(F.struct("doc_id", "d_source", "d_lang", "size")).alias("first")
    units = rows.groupBy("unit").agg(F.sum("size").cast("double").alias("weight"), first)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    scale = max(1, ((high or 0) - (low or 0)) // (_TOP - 2) + 1)
    units = units.select(
        "unit", "weight",
        F.least(F.col("first.size"), F.lit(_TOP - 1)).alias("d_size"), F.col("first.d_source").alias("d_source"), F.col("first.d_lang").alias("d_lang"),
        F.coalesce(F.expr(f"(cast(first.doc_id as decimal(20, 0)) - {low or 0}BD) div {scale}BD") + 1, F.lit(0).cast("long")).alias("d_id"),
        F.lit(0).alias("node"),
    )
    leaves = {0: (0, shards)}  # node: its first shard, and how many
    units, fixed, whole = settle(units), {}, None
    while any(n > 1 for _, n in leaves.values()):
        ranges = [f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))]
        stats = {r.node: r for r in units.groupBy("node").agg(F.sum("weight").alias("weight"), *ranges).collect()}
        if whole is None:
            whole = {d: max(1, stats[0][f"high_{d}"] - stats[0][f"low_{d}"]) for d in DIMENSIONS}
        nodes, new = {}, {}
        for n, (at, count) in leaves.items():
            if count == 1 or n not in stats:
                new[n] = (at, 1 if n not in stats else count)
                continue
            wide = max(DIMENSIONS, key=lambda d: (stats[n][f"high_{d}"] - stats[n][f"low_{d}"]) / whole[d])  # noqa: B023
            nodes[n] = (wide, count // 2 / count, stats[n].weight, (stats[n][f"low_{wide}"]) << 31, ((stats[n][f"high_{wide}"]) << 31) + _TOP - 1)
        if not nodes:
            break
        # a dimension's value, then a hash that parts equal values
        dim = F.coalesce(*[F.when(F.col("node").isin([n for n, x in nodes.items() if x[0] == d]), F.col(d)) for d in DIMENSIONS])
        keyed = units.withColumn("key", F.shiftleft(dim, 31) + F.shiftrightunsigned(F.xxhash64("unit"), 33))
        cut = _cuts(keyed, nodes, total, shards)
        at_cut = F.create_map(*[x for n, k in cut.items() for x in (F.lit(n), F.lit(k).cast("long"))])
        right = {n: 2 * n + 2 for n in nodes}
        for n in nodes:
            at, count = leaves[n]
            new[2 * n + 1], new[right[n]] = (at, count // 2), (at + count // 2, count - count // 2)
        node = F.when(F.col("node").isin(list(nodes)), F.when(F.col("key") < at_cut[F.col("node")], 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)).otherwise(F.col("node"))
        after = settle(keyed.withColumn("node", node.cast("int")).drop("key"))
        unsettle(units)
        units, leaves = after, new
    shard = F.create_map(*[x for n, (at, _) in leaves.items() for x in (F.lit(n), F.lit(at))])[F.col("node")]
    units = units.select("unit", "weight", shard.alias("shard"))
    moved = _moves(units, shards, total / shards, even) if even is not None else {}
    if moved:
        units = units.withColumn("shard", F.coalesce(_held(moved)[F.col("unit")], "shard"))
    placed = settle(rows.join(units.select("unit", "shard"), "unit").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane")))
    ahead = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("shard", "lane").count().withColumn("start", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32"))
    start = F.broadcast(start) if shards * lanes <= SENT else start
    return placed.withColumn("inside", inside).join(start, ["shard", "lane"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"))
