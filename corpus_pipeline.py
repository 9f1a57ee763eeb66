"""A training corpus, packed texts, from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next. All but the last return the columns of
documents. No stage can be put in SQL as a whole, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import importance, jaccard_join, mixing, packing, pseudonyms
from llm.common import scratch, settle, table, unsettle

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling takes."""
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one_of_each(docs, width=5, num=8, den=10)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data."""
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets."""
    # other columns travel under names that can't clash with the operator's
    named = {c: f"of {c}" for c in docs.columns if c not in ("doc_id", "text", "source")} | {"text": "of text"}
    held = docs.select("doc_id", "source", "text", *[F.col(c).alias(n) for c, n in named.items()])
    mixed = mixing.mix(held, carry=tuple(named.values()))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    repeated = mixed.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents, with their texts, in bins; a document that the mix repeats is its own duplicate and never shares a bin with itself."""
    return packing.pack(docs, text=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private_values), ("mixing sources", source_mix), ("best-fit packing", bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: doc_id, part, size, source, cluster, bin, bin_start and text. What a stage writes is deleted once the next one has read it; what the last one reads stays with the result."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as keep:
            done = keep(settle(stage(spark, docs, sf_dir)))
        unsettle(docs)
        docs = done
    return docs
