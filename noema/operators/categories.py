"""Category trees, membership, clustering and evolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.functions.scores import cosine
from noema.operators.blocks import SMALL, against, small, within
from noema.operators.letters import compared, letters
from noema.sources.store import cut

#: Rows of a set of characters that are kept together.
PART = 128


def _cosines(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Every point of a block with every centroid of another."""
    if not len(p) or not len(c):
        return pd.DataFrame({"id": [], "label": [], "sim": []})
    unit = lambda m: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))(np.stack(m.to_list()).astype(float))
    sim = unit(p["v"]) @ unit(c["c"]).T
    return pd.DataFrame({"id": np.repeat(p["id"].to_numpy(), len(c)), "label": np.tile(c["label"].astype(str).to_numpy(), len(p)), "sim": sim.ravel()})


def tree(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """nodes (id, parent) with level and path from the root; an unknown parent makes a root; nodes on cycles are left out. A tree deeper than ``depth`` is an error."""
    known = nodes.select(F.col("id").alias("pid"))
    rooted = nodes.join(known, nodes.parent == known.pid, "left").withColumn("parent", F.col("pid")).drop("pid")
    now = rooted.where("parent is null").select("id", F.lit(0).alias("level"), F.col("id").alias("path"))
    out = now
    for level in range(1, depth):
        up = now.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        now = rooted.join(up, "parent").select("id", F.lit(level).alias("level"), F.concat_ws("/", "above", "id").alias("path"))
        out = out.unionByName(now)
    up = now.select(F.col("id").alias("parent"))
    deeper = F.raise_error(F.lit(f"the tree has more than {depth} levels")).cast("int")
    return out.unionByName(rooted.join(up, "parent").select("id", deeper.alias("level"), F.col("id").alias("path")))


def near_best(points: DataFrame, centroids: DataFrame, margin: float) -> DataFrame:
    """For each point (id, v) all centroids (label, c) within the margin of its best; only points that have more than one."""
    if centroids.limit(SMALL + 1).count() <= SMALL:
        scored = points.join(F.broadcast(centroids)).select("id", "label", cosine(F.col("v"), F.col("c")).alias("sim"))
    else:
        scored = against(points.select("id", "v"), centroids.select(F.xxhash64("label").alias("id"), "label", "c"), _cosines, "id long, label string, sim double").withColumn("label", F.col("label").cast(centroids.schema["label"].dataType))
    w = Window.partitionBy("id")
    kept = scored.withColumn("best", F.max("sim").over(w)).where(F.col("best") - F.col("sim") < margin)
    return kept.withColumn("n", F.count("*").over(w)).where("n > 1").select("id", "label", F.round("sim", 6).alias("sim"))


def centroids(points: DataFrame, label: str) -> DataFrame:
    """The mean vector of each label, scaled to length 1."""
    flat = points.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    full = flat.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("a"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return full.select(label, F.transform("a", lambda x: F.when(F.col("n") > 0, x["m"] / F.col("n")).otherwise(x["m"])).alias("c"))


def diversity(points: DataFrame, label: str) -> DataFrame:
    """1 - mean pairwise cosine of each label, from the sum of unit vectors: no pair is made."""
    from noema.functions.scores import norm

    unit = points.withColumn("n", norm(F.col("v"))).where("n > 0")
    flat = unit.select(label, F.posexplode("v").alias("i", "x"), "n").groupBy(label, "i").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"), F.count("*").alias("k"))
    g = flat.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("k").alias("k")).where("k > 1")
    return g.select(label, (1 - (F.col("ss") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("diversity"))


def kmeans(points: DataFrame, min_size: int, seed: int = 42) -> DataFrame:
    """Unit vectors in k = max(2, min(n / min_size, 15)) clusters; fewer than min_size points are all noise (-1)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import Normalizer

    n = points.count()
    if n < min_size:
        return points.select("id", F.lit(-1).alias("cluster"))
    vec = Normalizer(inputCol="raw", outputCol="features").transform(points.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("raw")))
    model = KMeans(k=max(2, min(n // min_size, 15)), seed=seed).fit(vec)
    return model.transform(vec).select("id", F.col("prediction").alias("cluster"))


def search(cats: DataFrame, text: str, most: int = 20) -> DataFrame:
    """The first ``most``, by place, of cats (place, name, description) with the text in their name or description, letters' case aside. A null one holds nothing."""
    held = F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower())
    return cats.where(held).orderBy("place").limit(most)


def compare_sources(facts: DataFrame) -> DataFrame:
    """For each two sources (source_a < source_b) the pairs of facts that agree and that conflict.

    facts: source, fact, confidence; without one of these a row agrees and
    conflicts with none. Facts of over 0.5 character-set similarity, both over
    0.7 sure, agree; of over 0.15 to 0.4, with confidences over 0.2 apart, they
    conflict. Rows of one source, character set and confidence count as one with
    a weight, and a set is compared once for all its rows; sets meet in blocks,
    of which only counts come back. The work grows with the square of the
    distinct sets, as every pair counts.
    """
    sets = facts.where("source is not null and fact is not null and confidence is not null").select("source", F.col("confidence").cast("double"), letters(F.col("fact")).alias("chars"))
    rows = sets.groupBy("source", "confidence", "chars").agg(F.count("*").alias("n"))
    # a set of very many rows goes in parts
    part = F.floor((F.row_number().over(Window.partitionBy("chars").orderBy("confidence", "source")) - 1) / PART)
    held = rows.withColumn("part", part).groupBy("chars", "part").agg(F.collect_list(F.struct("source", "confidence", "n")).alias("held"))
    dealt = cut(held.select("chars", *(F.col(f"held.{c}").alias(c) for c in ("source", "confidence", "n")), F.xxhash64("chars", "part").alias("h")))
    found = within(dealt, compared, "source_a string, source_b string, agreeing long, conflicting long", 16).groupBy("source_a", "source_b").agg(F.sum("agreeing").alias("agreeing"), F.sum("conflicting").alias("conflicting"))
    names = facts.where("source is not null").select(F.col("source").alias("source_a")).distinct()
    pairs = names.join(small(names.select(F.col("source_a").alias("source_b"))), F.col("source_a") < F.col("source_b"))
    return pairs.join(found, ["source_a", "source_b"], "left").fillna(0, ["agreeing", "conflicting"])


def merge_triggers(centroids: DataFrame, least: float, idle_days: int) -> DataFrame:
    """Pairs a < b of categories (label, c, idle_days) at least that alike, one of which has been idle so long. Categories are few; their centroids are sent."""
    b = centroids.select(F.col("label").alias("b"), F.col("c").alias("c2"), F.col("idle_days").alias("idle2"))
    pairs = centroids.join(small(b), F.col("label") < F.col("b")).withColumn("sim", cosine(F.col("c"), F.col("c2")))
    return pairs.where((F.col("sim") >= least) & ((F.col("idle_days") >= idle_days) | (F.col("idle2") >= idle_days))).select(F.col("label").alias("a"), "b", "sim")


def merge_checks(made: DataFrame, least: float, idle_days: int) -> DataFrame:
    """Pairs a < b of categories (label, c, words, idle_days) at least that alike, one of which has been idle so long.

    Two with vectors (c) are compared by cosine, others by the share of keywords
    they have in common; without either they are unlike. For the keywords only
    categories that share one meet.
    """
    a, b = (made.select(F.col("label").alias(n), F.col("c").alias(f"c_{n}"), F.array_distinct("words").alias(f"w_{n}"), F.col("idle_days").alias(f"i_{n}")) for n in "ab")
    by_vector = a.where("c_a is not null").join(small(b.where("c_b is not null")), F.col("a") < F.col("b")).withColumn("sim", cosine(F.col("c_a"), F.col("c_b")))
    shared = a.select("a", F.explode("w_a").alias("w")).join(b.select("b", F.explode("w_b").alias("w")), "w").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    by_words = shared.join(a, "a").join(b, "b").where("c_a is null or c_b is null").withColumn("sim", F.col("n") / (F.size("w_a") + F.size("w_b") - F.col("n"))).drop("n")
    both = by_vector.unionByName(by_words.select(by_vector.columns))
    return both.where((F.col("sim") >= least) & ((F.col("i_a") >= idle_days) | (F.col("i_b") >= idle_days))).select("a", "b", "sim")


def split_triggers(points: DataFrame, group: str, cluster: str, members: int, size: int, diverse: float) -> DataFrame:
    """Groups of at least ``members`` points (v), that unlike, with two clusters of at least ``size``."""
    n = points.groupBy(group, cluster).agg(F.count("*").alias("k")).groupBy(group).agg(F.sum("k").alias("members"), F.count_if(F.col("k") >= size).alias("clusters"))
    return n.join(diversity(points, group), group).where((F.col("members") >= members) & (F.col("clusters") >= 2) & (F.col("diversity") >= diverse))


def new_categories(facts: DataFrame, least: int, size: int) -> DataFrame:
    """Names, from the three commonest words, of the clusters (cluster, words) with at least ``size`` facts, if there are ``least`` facts at all."""
    n = facts.groupBy("cluster").agg(F.count("*").alias("n"))
    enough = facts.agg((F.count("*") >= least).alias("enough"))
    words = facts.select("cluster", F.explode("words").alias("word")).groupBy("cluster", "word").agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("k"), "word"))
    top = words.withColumn("r", rank).where("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " · ").alias("name"))
    return n.where(F.col("n") >= size).join(top, "cluster").join(F.broadcast(enough.where("enough"))).select("cluster", "n", "name")


def hybrid(points: DataFrame, clusters: DataFrame, least: int, size: int) -> DataFrame:
    """stage, name, n: groups of points (id, grp) of at least ``least``; the points in none of them by their clusters (id, cluster) of at least ``size``."""
    groups = points.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rest = points.join(small(groups.select("grp")), "grp", "left_anti").join(clusters, "id")
    found = rest.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    return groups.select(F.lit("structural").alias("stage"), F.col("grp").alias("name"), "n").unionByName(found.select(F.lit("semantic").alias("stage"), F.col("cluster").alias("name"), "n"))


def split(made: DataFrame, members: DataFrame, category: str, part: F.Column) -> tuple[DataFrame, DataFrame]:
    """The categories (id, parent, is_archived) and members (id, category) after one is split by ``part`` of its members."""
    moved = members.withColumn("category", F.when(F.col("category") == category, part).otherwise(F.col("category")))
    parts = members.where(F.col("category") == category).select(part.alias("id")).distinct()
    return made.unionByName(parts.select("id", F.lit(category).alias("parent"), F.lit(False).alias("is_archived"))), moved


def merge(made: DataFrame, members: DataFrame, gone: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The categories and members after some are merged into a new one; the old ones are archived."""
    new = made.sparkSession.createDataFrame([(name, None, False)], "id string, parent string, is_archived boolean")
    return archive(made, gone).unionByName(new), members.withColumn("category", F.when(F.col("category").isin(gone), name).otherwise(F.col("category")))


def archive(made: DataFrame, gone: list[str]) -> DataFrame:
    return made.withColumn("is_archived", F.col("is_archived") | F.col("id").isin(gone))


def updated(rows: DataFrame, key: str, changes: dict) -> DataFrame:
    """rows (id, ...) with the columns of one changed; names that aren't columns are passed over."""
    for name, value in changes.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.when(F.col("id") == key, F.lit(value)).otherwise(F.col(name)))
    return rows


def focused(nodes: DataFrame, hit: F.Column) -> DataFrame:
    """id of the nodes (id, parent, ...) that match or have one below them that does, however deep the tree; nodes on a cycle are each taken once."""
    up = nodes.select("id", "parent")
    now = cut(nodes.where(hit).select("id").distinct())
    out = now
    while not now.isEmpty():
        above = up.join(now, "id", "left_semi").where("parent is not null").select(F.col("parent").alias("id")).distinct()
        now = cut(above.join(out, "id", "left_anti"))
        out = out.unionByName(now)
    return out
