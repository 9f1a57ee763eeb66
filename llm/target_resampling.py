"""Operator 12: documents drawn toward the distribution of a target.

A word is a run of bytes of 0-9, a-z (A-Z lower-cased) and everything beyond
ASCII; a feature is a word or two consecutive words of one text joined by a
space, and falls into the bucket crc32 modulo ``BUCKETS``. A bucket's gain is the
smoothed log ratio of its share among the target's features to its share among
all documents' features, in thousandths. A document's weight is the floored mean
of its features' gains; seeded Gumbel noise makes the draw.

A batch's texts are joined with a sentinel between them, and one pass of a
regular expression splits the whole buffer into gaps and words. The running sum
of the lengths gives each word's place, ``searchsorted`` in the documents'
offsets its document, and two neighbours of different documents are no feature.
What is left goes into one ``bincount``.

Two passes read the texts; between tasks go bucket counts and a few numbers a
document, never a text. The ranks come from a range sort and the rows counted
in each of its partitions, so no task sees more than its part of the order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import scratch, settle, small_batches

BUCKETS = 10_000
#: Share of the documents that are long enough, in percent, that is drawn.
PERCENT = 25
#: Words that a document needs to take part in the draw.
LEAST = 20
SEED = 7
#: Bytes of text that are split at a time.
CHUNK = 1 << 21

_WORD = re.compile(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_SENTINEL = b"\x00"


def _pieces(texts: list) -> Iterator[tuple[int, bytes]]:
    """(document, lower-cased bytes); a text beyond ``CHUNK`` comes in pieces that end where no word is cut."""
    for doc, text in enumerate(texts):
        held, at = (text or "").encode().lower(), 0
        while at < len(held):
            gap = _GAP.search(held, at + CHUNK)
            end = gap.start() if gap else len(held)
            yield doc, held[at:end] if at or gap else held
            at = end


def _chunks(texts: list) -> Iterator[tuple[list[int], list[bytes]]]:
    docs: list[int] = []
    held: list[bytes] = []
    size = 0
    for doc, piece in _pieces(texts):
        docs.append(doc)
        held.append(piece)
        size += len(piece)
        if size >= CHUNK:
            yield docs, held
            docs, held, size = [], [], 0
    if held:
        yield docs, held


def features(texts: list, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of every feature of the texts, chunk by chunk."""
    last_doc, last_crc = -1, 0  # the word before the chunk, whose text may go on
    for docs, held in _chunks(texts):
        parts = _WORD.split(_SENTINEL.join(held))
        words = parts[1::2]
        if not words:
            continue
        starts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1:2]
        offsets = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        doc = np.asarray(docs)[np.searchsorted(offsets, starts, side="right") - 1]
        one = list(map(crc32, words))
        before = [last_crc, *one[:-1]]
        two = np.fromiter(map(crc32, words, map(crc32, repeat(b" "), before)), np.int64, len(words))
        joined = doc == np.concatenate([[last_doc], doc[:-1]])
        yield np.concatenate([doc, doc[joined]]), np.concatenate([np.array(one, np.int64), two[joined]]) % buckets
        last_doc, last_crc = int(doc[-1]), one[-1]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts (one column, ``text``) in each bucket that holds any."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0).to_pylist(), buckets):
                n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from all texts of both tables. ``buckets`` rows come to the driver."""
    counts = []
    for texts in (docs, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, buckets).collect():
            n[r.bucket] = r.n
        counts.append(n.astype(np.float64))
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for doc, bucket in features(batch.column(1).to_pylist(), len(gain)):
                n += np.bincount(doc, minlength=len(n))
                np.add.at(total, doc, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored; the id and the seed fix it (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with the column ``rank``, from 1 without a gap in the order given.

    A range sort deals the rows; each partition's number of rows (one number for
    each partition comes to the driver) says where the next begins.
    """
    spark = rows.sparkSession
    with scratch(spark) as keep:
        # the id counts the rows of each partition of the sorted table from its number times 2^33
        placed = keep(settle(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())))
    part = F.shiftright("__at", 33)
    counted = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first = np.cumsum([0] + [n for _, n in counted])
    offsets = spark.createDataFrame([(p, int(f)) for (p, _), f in zip(counted, first, strict=False)], "__part long, __first long")
    # as many rows as the sort had partitions
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn("rank", F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__first", "__at")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for every row of docs (doc_id, text).

    target: texts (column ``text``) whose distribution is aimed at. Of the N
    documents with at least ``least`` words, the floor of ``percent``*N/100 of the
    highest scores are drawn and numbered from 1; ties go to the smaller doc_id,
    then to more features; a null doc_id comes last. Others have a null rank.

    Null and empty texts have no feature, weight 0 and only their noise as
    score. Repeated rows score alike and are drawn one by one. Of rows with a
    null doc_id all have one noise. Columns beyond doc_id and text are ignored.
    Empty tables give no rows, or gains from the other table alone.
    """
    scored = settle(weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_features") >= 2 * least - 1  # n words give 2n - 1 features
    ranked = numbered(scored.where(enough), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"))
    wanted = scored.where(enough).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
