"""Operator 8: quality by importance resampling.

Two generative models over hashed word unigrams and bigrams are counted: one of
the target text (documents labelled good), one of the raw text (all documents).
A document's log importance weight is ``TEMPER`` times the mean log ratio of the
two over its n-grams (and ``PRIOR`` more of ratio 0, so that a few words can't
weigh much). The mean, unlike the sum, doesn't grow with the length.

Two things follow from the weights. A threshold fitted on labelled documents
accepts or rejects (``keep_sampled``, and ``accepted`` of ``sample``). Of what it
accepts, ``sample`` draws a stated share: the log weights are brought to a
standard deviation of 1, about that of the noise, at whatever size of table;
seeded Gumbel noise is added and the k highest are kept, which samples k
documents without replacement in proportion to the weights so tempered.

Two passes read the text. Each sends only vectors of ``BUCKETS`` counts or one
number a document. The k-th highest key is found by radix selection on counts,
so no sort and no row of the result goes through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import settle, small_batches, unsettle
from llm.shingles import mix, words_of_batch

#: Hashed n-gram buckets of a model.
BUCKETS = 1 << 16
#: Labelled documents of either kind that the target model and the threshold are fitted on, at most.
LABELLED = 50_000
#: Share of the good labelled documents that the threshold may put among the rejected.
MISSED = 0.0005
#: Inverse temperature of the weights, and n-grams of ratio 0 that every document has besides its own.
TEMPER = 100.0
PRIOR = 30
#: Share of the accepted documents that ``sample`` draws.
SHARE = 0.5
SLICES = 16
SEED = 17


def _ngrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams, buckets of bigrams (-1 where the next word is another text's), word offsets."""
    h, at = words_of_batch(texts)
    one = (h % np.uint64(BUCKETS)).astype(np.int32)
    two = np.full(len(h), -1, np.int32)
    if len(h) > 1:
        two[:-1] = (mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) % np.uint64(BUCKETS)).astype(np.int32)
    ends = at[1:][np.diff(at) > 0] - 1
    two[ends] = -1
    return one, two, at


def _among(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Whether each id is one of ``wanted``; null isn't. Ids stay whole numbers throughout."""
    return np.isin(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), wanted) & pc.is_valid(ids).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """Counts of each bucket in the target and in all texts; target: doc_ids of the target documents."""
    shared = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sums = shared.value, np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            one, two, at = _ngrams(batch.column(1).to_pylist())
            word = np.repeat(_among(batch.column(0), wanted), np.diff(at))
            for row, mask in ((0, word), (1, None)):
                for grams in (one, two):
                    g = grams if mask is None else grams[mask]
                    sums[row] += np.bincount(g[g >= 0], minlength=BUCKETS)
        yield _rows({k: x for k, x in enumerate(np.split(sums, SLICES, axis=1))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x, np.int64).reshape(2, -1)
        yield _rows(held)

    def _rows(x: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int32()), pa.array([v.tobytes() for v in x.values()], pa.binary())], names=["slice", "sums"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "slice int, sums binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, sums binary").collect()
    sums = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        sums[:, r.slice * BUCKETS // SLICES : (r.slice + 1) * BUCKETS // SLICES] = np.frombuffer(r.sums, np.int64).reshape(2, -1)
    return sums


def log_ratio(sums: np.ndarray) -> np.ndarray:
    """Of each bucket, with one added to its counts; 0 everywhere without a target."""
    p = np.log(sums + 1.0) - np.log(sums.sum(axis=1, keepdims=True) + float(BUCKETS))
    return p[0] - p[1] if sums[0].any() else np.zeros(BUCKETS)


def log_weights(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], seed: int = SEED, weight: str = "log_weight", key: str = "gumbel_key") -> DataFrame:
    """docs with the columns ``weight`` and ``key`` added; model: the counts of ``fit`` and the target's doc_ids.

    A document of the target is weighed by the model without its own text, so
    it is no better off than one alike that nobody has labelled.
    """
    sums, target = model
    shared = docs.sparkSession.sparkContext.broadcast((log_ratio(sums), sums, target))
    at_text, at_id = docs.columns.index("text"), docs.columns.index("doc_id")
    kind = T.StructType([*docs.schema.fields, T.StructField(weight, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, sums, target = shared.value
        r = np.append(ratio, 0.0)  # bucket -1 weighs nothing
        n_target, raw = sums[0].sum(), np.log(sums[1] + 1.0) - np.log(sums[1].sum() + float(BUCKETS))
        for batch in batches:
            one, two, at = _ngrams(batch.column(at_text).to_pylist())
            total = np.concatenate([[0.0], np.cumsum(r[one] + r[two])])
            n, total = np.maximum(2 * np.diff(at) - 1, 0), total[at[1:]] - total[at[:-1]]
            for i in np.flatnonzero(_among(batch.column(at_id), target) & (n > 0)):
                g = np.concatenate([one[at[i] : at[i + 1]], two[at[i] : at[i + 1]]])
                b, c = np.unique(g[g >= 0], return_counts=True)
                left = np.log(np.maximum(sums[0][b] - c, 0) + 1.0) - np.log(max(0, n_target - n[i]) + float(BUCKETS))
                total[i] = c @ (left - raw[b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(TEMPER * total / (n + PRIOR), 6))], names=[*batch.schema.names, weight])

    return docs.mapInArrow(score, kind).withColumn(key, F.round(F.col(weight) + gumbel(F.col("doc_id"), seed), 6))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that the id and the seed fix."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), doc_id.cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_highest(keyed: DataFrame, key: str, k: int) -> float | None:
    """The k-th highest value of a double column, by counts of ever finer intervals; None for all rows."""
    if k <= 0:
        return float("inf")
    low, high, n = keyed.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return None
    above, bins = 0, 4096
    for _ in range(12):
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width))).cast("int")
        found = keyed.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
        if low == high or above + r.n == k:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept for every row of docs; see ``decide``."""
    weighed, lowest, _ = decide(docs, labels, **options)
    return weighed.withColumn("kept", F.lit(True) if lowest is None else F.col("gumbel_key") >= F.lit(lowest))


def sample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED, **options) -> DataFrame:
    """doc_id, log_weight, accepted, gumbel_key, kept for every row of docs: those that the threshold accepts, and the draw of a share of them.

    accepted and log_weight are as in ``decide``, with its options. The draw
    takes the floor(share * accepted) highest of log_weight / deviation + noise,
    deviation being that of the log weights of all accepted rows (1 where they
    are all alike or there are fewer than two). What is rejected has a null key
    and isn't kept. Rows that tie with the last one drawn are all kept. An empty
    table gives no rows.
    """
    weighed, cut, _ = weigh(docs, labels, seed, **options)
    found = weighed.withColumn("accepted", F.col("log_weight") >= F.lit(cut))
    n, deviation = found.where("accepted").agg(F.count("*"), F.stddev_pop("log_weight")).first()
    key = F.round(F.col("log_weight") / F.lit(round(deviation or 0.0, 6) or 1.0) + gumbel(F.col("doc_id"), seed), 6)
    found = found.withColumn("gumbel_key", F.when(F.col("accepted"), key))
    lowest = kth_highest(found.where("accepted"), "gumbel_key", int(share * n)) if n else None
    kept = F.col("accepted") if lowest is None else F.col("accepted") & (F.col("gumbel_key") >= F.lit(lowest))
    return found.select("doc_id", "log_weight", "accepted", "gumbel_key", kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that ``decide`` samples, with their columns; weighed again rather than joined, so that no text is shuffled."""
    weighed, lowest, model = decide(docs, labels, **options)
    unsettle(weighed)
    if lowest is None:
        return docs
    return log_weights(docs, model, options.get("seed", SEED), "__weight", "__key").where(F.col("__key") >= F.lit(lowest)).select(*docs.columns)


def decide(docs: DataFrame, labels: DataFrame, seed: int = SEED, labelled: int = LABELLED, missed: float = MISSED, k: int | None = None) -> tuple[DataFrame, float | None, tuple]:
    """The weights (doc_id, log_weight, gumbel_key) of all rows of docs (doc_id, text), the lowest key that is kept (None: all), and the model.

    labels: doc_id, quality (1 good, 0 not; other values and nulls are ignored).
    At most ``labelled`` rows of each quality, those of the lowest hashes, fit
    the target model and the threshold. Without ``k``, k is the number of
    documents whose weight reaches the threshold that tells good from bad
    labelled documents best while losing at most ``missed`` of the good; without
    labels of both kinds, k is all.

    Null and empty texts weigh log 1 = 0. Rows that tie with the k-th key are
    all kept, repeated rows among them, and so are rows with a null doc_id by
    their weight (their noise is that of null). An empty table gives no rows.
    """
    weighed, cut, model = weigh(docs, labels, seed, labelled, missed, k is None)
    if k is None:
        k = weighed.where(F.col("log_weight") >= F.lit(cut)).count()
    return weighed, kth_highest(weighed, "gumbel_key", k), model


def weigh(docs: DataFrame, labels: DataFrame, seed: int = SEED, labelled: int = LABELLED, missed: float = MISSED, cut: bool = True) -> tuple[DataFrame, float, tuple]:
    """The weights of all rows of docs, the weight that tells good from bad (-inf without labels of both kinds, or if ``cut`` isn't asked for), and the model; see ``decide``."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = {q: [r.doc_id for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()] for q in (0, 1)}
    good, bad = (np.array(sorted(picked[q]), np.int64) for q in (1, 0))
    model = (fit(docs, good), good)
    weighed = settle(log_weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, seed).drop("text"))
    if not cut or not len(good) or not len(bad):
        return weighed, float("-inf"), model
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = shared.value
        for batch in batches:
            is_good = _among(batch.column(0), yes)
            keep = pa.array(is_good | _among(batch.column(0), no))
            yield pa.RecordBatch.from_arrays([pa.array(is_good).filter(keep), batch.column(1).filter(keep)], names=["good", "weight"])

    counted = weighed.select("doc_id", "log_weight").mapInArrow(pick, "good boolean, weight double").groupBy("good", "weight").count().toPandas()
    limit = threshold(*[x for q in (True, False) for x in (counted[counted.good == q].weight.to_numpy(), counted[counted.good == q]["count"].to_numpy())], missed) if counted.good.nunique() == 2 else float("-inf")
    return weighed, limit, model


def threshold(good: np.ndarray, n_good: np.ndarray, bad: np.ndarray, n_bad: np.ndarray, missed: float) -> float:
    """The weight at which most of the bad stay below, with at most ``missed`` of the good below; half way down to the next bad weight."""
    order = np.argsort(good)
    good, n_good = good[order], n_good[order]
    lost = np.cumsum(n_good) / n_good.sum()
    first = int(np.searchsorted(lost, missed, side="right"))
    limit = good[min(first, len(good) - 1)]
    below = bad[bad < limit]
    return float((below.max() + limit) / 2) if len(below) else float(limit)
