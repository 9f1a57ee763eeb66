"""De-duplication: exact hashes, prefixes, vectors, versions, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.operators import cosine_join, substrings


def exact(docs: DataFrame, text: str) -> DataFrame:
    """Each hash with its first id, last id and number of rows (its version)."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("hash")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("version"))


def first_by_prefix(docs: DataFrame, text: str, chars: int = 50) -> DataFrame:
    """The row of the smallest id for each prefix; an aggregate, so a frequent prefix is reduced before the shuffle."""
    row = F.struct(*docs.columns)
    return docs.groupBy(F.substring(text, 1, chars).alias("_prefix")).agg(F.min_by(row, F.struct("id", text)).alias("_row")).select("_row.*")


def similar_pairs(asked: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Each asked vector (id, v) with the other vectors whose cosine with it is at least the threshold, 4 places; see ``cosine_join``."""
    return cosine_join.Plan(asked, vectors, threshold).pairs()


def equal_pairs(facts: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` pairs (first, second, fact, first_version, second_version) of facts (id, fact, version) that are equal, by ids.

    The first pairs of a fact are those of its smallest ids, so no more than
    ``most`` + 1 rows of a fact meet, however many are alike.
    """
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("id"))
    few = facts.where("id is not null and fact is not null").select("id", "version", F.sha2("fact", 256).alias("hash")).withColumn("nth", nth).where(F.col("nth") <= most + 1).drop("nth")
    a, b = (few.select("hash", F.col("id").alias(x), F.col("version").alias(f"{x}_version")) for x in ("first", "second"))
    pairs = a.join(b, "hash").where("first < second").orderBy("first", "second").limit(most)
    return pairs.join(facts.select(F.col("id").alias("first"), "fact"), "first").select("first", "second", "fact", "first_version", "second_version")


def decide(hash_match: F.Column, sim: F.Column, mode: str, high: float = 0.95, warn: float = 0.85) -> F.Column:
    """skip, warn or proceed, by mode strict, loose or manual."""
    strict = F.when(hash_match | (sim >= high), "skip").when(sim >= warn, "warn").otherwise("proceed")
    loose = F.when(hash_match, "skip").when(sim >= warn, "warn").otherwise("proceed")
    manual = F.when(hash_match | (sim >= warn), "warn").otherwise("proceed")
    return {"strict": strict, "loose": loose, "manual": manual}[mode]


def merge_triples(triples: DataFrame) -> DataFrame:
    """One row for each (src, rel, dst): the newest confidence by seq, the highest, the sources in order, how many merged."""
    return triples.groupBy("src", "rel", "dst").agg(F.max_by("conf", "seq").alias("conf"), F.max("conf").alias("max_conf"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("merged"))


def bumped(registry: DataFrame, arriving: DataFrame) -> DataFrame:
    """The registry (hash, version) after files (hash) arrive: each goes up a version for every arrival, unknown ones begin at 1."""
    new = arriving.groupBy("hash").agg(F.count("*").alias("new"))
    return registry.join(new, "hash", "full").select("hash", (F.coalesce("version", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("version"))


def _simple(c: F.Column) -> F.Column:
    return F.substring(F.regexp_replace(F.lower(c), r"[，,。；;：:\s]+", ""), 1, 200)


def _characters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, chars: a simple text's length and the set of its characters. Null and empty texts have none and go."""
    simple = _simple(F.col(text))
    return rows.select(key, F.length(simple).alias("n"), F.array_sort(F.array_distinct(F.split(simple, ""))).alias("chars")).where("n > 0")


def triple_candidates(facts: DataFrame, triples: DataFrame, least: float) -> DataFrame:
    """a, n_a, b, n_b, k: sets of characters that may share over ``least`` of the longer text's length, each pair once, with the smallest k of b's triples.

    Texts of one set and length count as one. Two of them share more than ``least`` of either's own length, so a text with fewer characters than that
    shares it with none, and of the others the rarest characters, all but as many as that, hold one of the other's rarest ones.
    """
    needed = F.floor(F.lit(least) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    able = lambda rows: rows.where(F.size("chars") >= needed)
    of_a = able(_characters(facts, "id", "fact")).select("chars", "n").distinct()
    of_b = able(_characters(triples, "k", "triple")).groupBy("chars", "n").agg(F.min("k").alias("k"))
    seen = of_a.select(F.explode("chars").alias("c")).unionAll(of_b.select(F.explode("chars").alias("c"))).groupBy("c").agg(F.count("*").alias("df"))

    def rarest(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("c", F.explode("chars")).join(seen, "c").groupBy(*rows.columns).agg(F.array_sort(F.collect_list(F.struct("df", "c")))["c"].alias("order"))
        return placed.withColumn("first", F.slice("order", F.lit(1), F.size("chars") - needed + 1))

    a = rarest(of_a).select(F.col("chars").alias("a"), F.col("n").alias("n_a"), F.col("first").alias("first_a"), F.explode("first").alias("c"))
    b = rarest(of_b).select(F.col("chars").alias("b"), F.col("n").alias("n_b"), "k", F.col("first").alias("first_b"), F.explode("first").alias("c"))
    longest = F.greatest("n_a", "n_b") * F.lit(least)
    fits = (F.size("a") > longest - 1e-9) & (F.size("b") > longest - 1e-9)
    # both are in one order: the first that they share is one character
    return a.join(b, "c").where(fits & (F.element_at(F.array_intersect("first_a", "first_b"), 1) == F.col("c"))).select("a", "n_a", "b", "n_b", "k")


def nearest_triple(facts: DataFrame, triples: DataFrame, least: float = 0.6, merge: float = 0.85) -> DataFrame:
    """For each fact (id, fact) the triple (k, triple) whose characters it shares most, relative to the longer text, if that is over ``least``; merged from ``merge`` on. The smallest k of equals."""
    score = F.round(F.size(F.array_intersect("a", "b")) / F.greatest("n_a", "n_b"), 9)
    pairs = triple_candidates(facts, triples, least).withColumn("score", score).where(F.col("score") > least)
    best = pairs.groupBy(F.col("a").alias("chars"), F.col("n_a").alias("n")).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))
    return _characters(facts, "id", "fact").join(best, ["chars", "n"]).select("id", "k", "score", (F.col("score") >= merge).alias("merged"))


def normalised(names: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """names (id, name) against entities (name, canonical, aliases): merged with the canonical name that equals it or one of whose aliases does, else similar_found where a name has its first 30 characters, else unique. With ``force`` the first similar one is taken.

    Names that hold those characters come from an index for substrings, aliases by equality. An empty name is in every name; a null one is unique.
    """
    k = known.select(F.lower("name").alias("_low"), F.coalesce("canonical", "name").alias("_canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("_aliases"))
    # equal names are looked up once
    asked = names.where("name <> ''").select("name", F.substring(F.lower("name"), 1, 30).alias("_asked")).distinct()
    texts = k.where("_low is not null").select(F.col("_low").alias("id"), F.col("_low").alias("text")).distinct()
    patterns = asked.select(F.col("_asked").alias("k"), F.col("_asked").alias("pattern")).distinct()
    named = substrings.holding(substrings.index(texts), texts, patterns).select(F.col("k").alias("_asked"), F.col("id").alias("_low")).join(k, "_low")
    called = k.withColumn("_asked", F.explode(F.array_distinct("_aliases")))
    same = lambda low: (F.lower("_canonical") == low) | F.exists("_aliases", lambda x: F.lower(x) == low)
    found = lambda low: (F.min(F.when(same(low), F.col("_canonical"))).alias("best"), F.min("_canonical").alias("first"))
    hits = asked.join(named.unionByName(called), "_asked").groupBy("name").agg(*found(F.lower("name")))
    hits = hits.unionByName(k.agg(*found(F.lit(""))).select(F.lit("").alias("name"), "best", "first"))
    best = F.coalesce("best", "first") if force else F.col("best")
    merged = best.isNotNull() & (best != F.col("name"))
    out = names.join(hits, "name", "left")
    return out.select("id", "name", F.when(merged, "merged").when(F.col("first").isNull(), "unique").otherwise("similar_found").alias("status"), F.when(merged, best).alias("canonical"))


def sample_consistency(samples: DataFrame, over: float = 0.3) -> DataFrame:
    """For each question (of) the share of pairs of its samples (turn, fact) whose sets of characters are alike; 0.5 with fewer than two. A question has few samples."""
    from noema.functions.text import char_jaccard

    a = samples.select("of", F.col("turn").alias("i"), F.col("fact").alias("a"))
    b = samples.select("of", F.col("turn").alias("j"), F.col("fact").alias("b"))
    pairs = a.join(b, "of").where("i < j").groupBy("of").agg(F.avg((char_jaccard(F.col("a"), F.col("b")) > over).cast("int")).alias("x"))
    return samples.select("of").distinct().join(pairs, "of", "left").select("of", F.coalesce("x", F.lit(0.5)).alias("consistency"))
