"""Retrieval and ranking: BM25, vector search, fusion, quality of what was retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noema.functions.scores import cosine
from noema.functions.text import tokens


def postings(docs: DataFrame, text: str, whole: bool = False) -> DataFrame:
    """id, term, tf, length of each distinct term of each text; with ``whole`` also a row without a term for the text itself.

    A text's terms are sorted and counted in its own row, so nothing is shuffled.
    """
    t = docs.select("id", F.sort_array(tokens(F.col(text))).alias("t")).select("id", "t", F.size("t").alias("length"))
    new = F.filter(F.transform("t", lambda x, k: F.when((k == 0) | (x != F.get("t", k - 1)), k)), lambda k: k.isNotNull())
    counted = lambda k, n: F.struct(F.get("t", k).alias("term"), (F.coalesce(F.get("new", n + 1), F.col("length")) - k).cast("long").alias("tf"))
    terms = F.transform("new", counted)
    if whole:
        terms = F.concat(terms, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf"))))
    return t.withColumn("new", new).select("id", "length", F.explode(terms).alias("x")).select("id", "x.term", "x.tf", "length")


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count("*").alias("total_docs"), F.avg("n").alias("avg_len"))


def bm25(docs: DataFrame, text: str, query: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k documents of the highest scores above 0, ties to the smaller id; query terms count as often as they stand there."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, times int")
    held = docs.select("id", tokens(F.col(text)).alias("t"))
    total = held.select(F.size("t").alias("n")).agg(F.count("*").alias("total"), F.avg("n").alias("avg_len"))
    # only the query's terms leave the scan
    wanted = held.select("id", F.size("t").alias("length"), F.explode(F.filter("t", lambda x: x.isin(list(dict.fromkeys(query))))).alias("term"))
    tf = wanted.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    return _scored(tf, asked, total, k, k1, b)


def _scored(tf: DataFrame, asked: DataFrame, total: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # a row for each of the query's terms, and one row of totals
    scored = tf.join(F.broadcast(df.join(F.broadcast(asked), "term")), "term").join(F.broadcast(total))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest("avg_len", F.lit(1.0)))) * F.col("times")
    return scored.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def vector_top(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors of the highest cosine with the one query vector (columns id, v)."""
    q = F.broadcast(query.select(F.col("v").alias("q")).limit(1))
    return vectors.join(q).select("id", cosine(F.col("v"), F.col("q")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(lanes: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lanes (id, score), each ranked from 1. A lane is a search's list of its best rows, so its ranking is one small window; every row of it gets its rank."""
    ranked = None
    for n, lane in enumerate(lanes):
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        one = lane.select(F.lit(n).alias("lane"), "id", rank.alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("rrf"), F.count("*").alias("lanes")).orderBy(F.desc(F.round("rrf", 9)), "id").limit(k)


def quality(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Count, mean and best score of hits (score, source), whether the mean is below the threshold, whether two sources agree."""
    return hits.agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.coalesce(F.avg("score") < threshold, F.lit(True)).alias("below"), (F.countDistinct("source") >= 2).alias("multi_source"))


def conflicts(hits: DataFrame, most: int = 3) -> DataFrame:
    """Of hits (place, fact) those whose first 30 characters, marks and spaces aside, an earlier hit has: place, fact and earlier, up to 50 characters of each; the first ``most``."""
    start = F.regexp_replace(F.substring("fact", 1, 30), r"[，,。；;：:\s]+", "")
    first = F.first("fact").over(Window.partitionBy("start").orderBy("place"))
    again = hits.withColumn("start", start).withColumn("earlier", first).withColumn("nth", F.row_number().over(Window.partitionBy("start").orderBy("place"))).where("nth > 1")
    return again.orderBy("place").limit(most).select("place", F.substring("fact", 1, 50).alias("fact"), F.substring("earlier", 1, 50).alias("earlier"))


def keywords(docs: DataFrame, col: Column, n: int) -> DataFrame:
    """The n most frequent words, ties by word."""
    return docs.select(F.explode(col).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def variants(asked: DataFrame, rewrites: Column | None = None, most: int = 4) -> DataFrame:
    """asked (query, ...) with its variants: the query, then a model's rewrites without repeats, ``most`` in all; without a model the query alone."""
    all_ = F.array("query") if rewrites is None else F.concat(F.array("query"), F.coalesce(rewrites, F.array().cast("array<string>")))
    return asked.withColumn("variants", F.slice(F.array_distinct(F.array_compact(all_)), 1, most))


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The search index of the documents: postings (id, term, tf, length) and lengths (id, length).

    Built once and kept. Postings are dealt and sorted by term, so that a query
    reads those of its terms only.
    """
    from noema.operators.segments import of_documents

    held = of_documents(spark, sf_dir)
    return held.postings(), held.lengths()


def ranked(held: DataFrame, lengths: DataFrame, query: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25`` from an index."""
    asked = held.sparkSession.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, times int")
    total = lengths.agg(F.count("*").alias("total"), F.avg("length").alias("avg_len"))
    tf = held.where(F.col("term").isin(list(dict.fromkeys(query))))
    return _scored(tf, asked, total, k, k1, b)


def key_sentences(docs: DataFrame, words: list[str], most: int, longer_than: int = 5) -> DataFrame:
    """id, p (place in the text), sentence: of each text (id, text) the ``most`` sentences with the most of the words, the first ones where none has any."""
    from noema.functions.text import count_of

    parts = F.transform(F.split("text", "[。！？\\n]+"), lambda x, p: F.struct((-count_of(F.lower(x), words)).alias("h"), p.alias("p"), F.trim(x).alias("sentence")))
    long = F.filter(parts, lambda x: F.length(x["sentence"]) > longer_than)
    hit = F.filter("x", lambda y: y["h"] < 0)
    best = F.slice(F.array_sort(F.when(F.size(hit) > 0, hit).otherwise(F.col("x"))), 1, most)
    return docs.select("id", long.alias("x")).select("id", F.explode(best).alias("y")).select("id", "y.p", "y.sentence")


def chunked(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """id, start (characters before it), chunk: overlapping pieces of each text (id, text); a text of up to ``size`` is one, an empty one none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = docs.where("text <> ''").select("id", "text", F.explode(starts).alias("start"))
    return cut.select("id", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, start, digest of the chunks of the documents, kept; the digest is all that a chunk's vector is made of."""
    from noema.sources.store import kept
    from noema.sources.tables import read

    docs = lambda: read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return kept(spark, "chunks-1", [f"{sf_dir}/documents.parquet"], lambda: chunked(docs()).select("id", "start", F.sha2("chunk", 256).alias("digest")))


def nearest_chunks(chunks: DataFrame, question: str) -> DataFrame:
    """chunks (id, start, digest) with their score, the cosine with the question's vector, 9 places."""
    from noema.functions.scores import digest_vector

    q = digest_vector(F.sha2(F.lit(question), 256))
    return chunks.select("id", "start", F.round(cosine(digest_vector(F.col("digest")), q), 9).alias("score"))


def with_chunks(fused: DataFrame, scored: DataFrame, most: int = 5) -> DataFrame:
    """The fused list (id, score) with the place of each fact's best chunk, and beside it the ``most`` best chunks of all.

    kind (fact or chunk), id, start, score. ``scored``: id, start, score of the
    chunks. Equal chunks are told by the smaller id and place.
    """
    best = scored.join(F.broadcast(fused.select("id")), "id", "left_semi").groupBy("id").agg(F.max_by("start", F.struct("score", -F.col("start"))).alias("start"))
    facts = fused.join(best, "id", "left").select(F.lit("fact").alias("kind"), "id", "start", "score")
    top = scored.orderBy(F.desc("score"), "id", "start").limit(most)
    return facts.unionByName(top.select(F.lit("chunk").alias("kind"), "id", "start", "score"))
