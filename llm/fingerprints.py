"""Operator 13: document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, those into phrases of phrases, and
so on up to one name for the whole text. A level goes in three steps:

* runs of one symbol become one item (symbol, length), so neighbours differ;
* deterministic coin tossing: an item's label is twice the lowest bit in which
  its symbol differs from the one on its left, plus that bit. Neighbours' labels
  still differ, and a few rounds bring 64 bits down to six labels;
* a phrase begins where a label is a local maximum, and its name is a hash of the
  items in it.

Where a phrase begins depends on a few items to its left and one to its right
only. So equal substrings get the same names, but for some phrases at their
ends, wherever they stand, and an edit changes the names around it only.

A fingerprint is the ``KEPT`` smallest of the hashed names of level ``LOWEST`` and
up, and of the whole text's name, as eight hex digits each. Two fingerprints tell
the share of phrases that two texts have in common (Dice's measure).

Everything works on arrays of a whole chunk of texts. ``edited`` pairs each
document with the next one by a range sort, so a document meets its
neighbour within a partition, and only one text from either end of each
partition goes any further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import scratch, settle, small_batches
from llm.shingles import mix

#: Names that a fingerprint keeps, and the lowest level they are from (phrases of about a dozen bytes).
KEPT = 64
LOWEST = 2
#: Bytes of text that are parsed at a time; a longer text is parsed alone.
CHUNK = 1 << 19

_U = np.uint64


def _tossed(n: int) -> np.ndarray:
    """Label of each symbol below n after each left neighbour below n: [left, symbol]."""
    left, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    differ = left ^ x
    low = np.zeros((n, n), np.int64)
    for k in range(n.bit_length() - 1, -1, -1):
        low[(differ >> k) & 1 == 1] = k
    return (2 * low + ((x >> low) & 1)).astype(np.uint8)


_BYTES, _SEVEN_BITS, _FOUR_BITS, _THREE_BITS = _tossed(256), _tossed(128), _tossed(16), _tossed(8)


def _again(table: np.ndarray, label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on labels; the first of a text has a left neighbour that differs in the lowest bit."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = label[first] ^ 1
    return table[left, label]


def labels(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours' labels differ, as their symbols do. first: places at which a text begins."""
    if symbol.dtype == np.uint8:
        label = _again(_BYTES, symbol, first)
    else:
        left = np.empty_like(symbol)
        left[1:] = symbol[:-1]
        left[first] = symbol[first] ^ _U(1)
        differ = left ^ symbol
        low = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)).astype(_U)
        label = _again(_SEVEN_BITS, (_U(2) * low + ((symbol >> low) & _U(1))).astype(np.uint8), first)
    return _again(_THREE_BITS, _again(_FOUR_BITS, label, first), first)


def phrases(symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and text of each phrase of one level; text: which text each symbol is of, ascending."""
    begins = np.empty(len(symbol), bool)
    begins[0] = True
    np.not_equal(text[1:], text[:-1], out=begins[1:])
    item = begins.copy()
    item[1:] |= symbol[1:] != symbol[:-1]
    at = np.flatnonzero(item)
    run = np.diff(at, append=len(symbol)).astype(_U)
    symbol, text, begins = symbol[at], text[at], begins[at]
    label = labels(symbol, np.flatnonzero(begins))
    cut = begins
    if len(label) > 2:
        peak = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        peak &= ~begins[2:] & ~begins[1:-1]  # a text's last item has no right neighbour
        cut[1:-1] |= peak
    at = np.flatnonzero(cut)
    place = (np.arange(len(symbol)) - np.repeat(at, np.diff(at, append=len(symbol)))).astype(_U)
    hashed = mix(symbol.astype(_U) * _U(0x9E3779B97F4A7C15) + run * _U(0xC2B2AE3D27D4EB4F) + (place + _U(1)) * _U(0x165667B19E3779F9))
    return mix(np.add.reduceat(hashed, at)), text[at]


def names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed names of level ``LOWEST`` and up, and of the whole texts, and the text each is of. Empty texts have none."""
    text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    symbol, level = np.frombuffer(b"".join(texts), np.uint8), 0
    found, whose = [], []
    while len(symbol):
        symbol, text = phrases(symbol, text)
        level += 1
        n = np.bincount(text, minlength=len(texts))
        top = n[text] == 1
        out = top if level < LOWEST else np.ones(len(symbol), bool)
        found.append(mix(symbol[out] + _U(level)))
        whose.append(text[out])
        symbol, text = symbol[~top], text[~top]
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def _chunked(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > CHUNK:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def sketches(texts: list[bytes], kept: int = KEPT) -> list[np.ndarray]:
    """Of each text the ``kept`` smallest distinct values, ascending."""
    out = []
    for held in _chunked(texts):
        name, text = names(held)
        value = (name >> _U(32)).astype(np.int64)
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
        at = np.searchsorted(text, np.arange(len(held) + 1))
        out += [value[a : min(a + kept, b)] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def written(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u4").tobytes()


def _in_hex(df: DataFrame) -> DataFrame:
    return df.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of phrases in common, 0 to 1: 2J/(1 + J), J being the share of the smallest names of both that both have. 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:kept]
    common = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
    j = float(common.sum()) / len(both)
    return 2 * j / (1 + j)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs (doc_id, text); null texts count as empty, whose fingerprint is an empty string."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [written(x) for x in sketches([(t or "").encode() for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["doc_id", "fingerprint"])

    return _in_hex(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fingerprint binary"))


#: The result as it is written on the way, digests in bytes.
_DONE = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ENDS = "part int, head string, tail_id long, tail string"


def _compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of the result for texts and the texts that follow them."""
    changed = []
    for text, after in zip(texts, following, strict=True):
        k = len(text) // 3
        changed.append((text[: len(text) - k] + after[:k]).encode())
    # a text that is also the one before's next is parsed once
    place: dict[str, int] = {}
    for x in [*texts, *following]:
        place.setdefault(x, len(place))
    plain = sketches([x.encode() for x in place])
    edited = sketches(changed)
    own, after = [plain[place[x]] for x in texts], [plain[place[x]] for x in following]
    near = lambda pairs: pa.array([round(likeness(a, b), 6) for a, b in pairs], pa.float64())
    return [
        pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in changed], pa.binary()),
        pa.array([written(x) for x in own], pa.binary()), pa.array([written(x) for x in edited], pa.binary()), near(zip(own, edited, strict=True)), near(zip(own, after, strict=True)),
    ]


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), of its edited text, and how alike they are.

    doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited (its fingerprint and the edited text's),
    near_next (its and the next document's), from 0 to 1. A null text is an empty
    one. In the edited text the last n_chars // 3 code points have given way to
    as many of the first ones of the next document, or all it has. Next is by
    descending doc_id, after the last the first; rows of one doc_id follow by a
    hash of their texts, null ids come last. A lone document is its own next.
    Other columns are ignored. An empty table gives no rows.

    Equal texts have equal fingerprints, empty ones an empty string. Texts under
    a dozen bytes have few phrases, often only the whole text's name, so small
    edits of them look like other texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # rows alike in id and text can follow each other in any order, so many of them may be spread over partitions
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), "tie", "spread"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares each row with the one after it; leaves the partition's first text and its last row for ``ends``."""
        head = held = part = None
        none = lambda n: [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        columns = ["ends", *[c.split()[0] for c in _DONE.split(", ")], *[c.split()[0] for c in _ENDS.split(", ")]]
        for batch in batches:
            ids, texts, part = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)[0].as_py()
            if not ids:
                continue
            head = texts[0] if head is None else head
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            n = len(ids) - 1
            if n:
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), *_compared(ids[:-1], texts[:-1], texts[1:]), *empty], names=columns)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([True]), *none(1), pa.array([part], pa.int32()), pa.array([head]), pa.array([held[0]], pa.int64()), pa.array([held[1]])], names=columns)

    with scratch(spark) as keep:
        walked = keep(settle(dealt.mapInArrow(walk, f"ends boolean, {_DONE}, {_ENDS}")))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_compared(*[c.to_pylist() for c in batch.columns]), names=[c.split()[0] for c in _DONE.split(", ")])

    # one row for each partition; only their numbers meet in one window, the texts by a join
    ends = walked.where("ends")
    whole = Window.orderBy("part")
    after = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(whole), F.min("part").over(whole)))
    pairs = ends.select("part", "tail_id", "tail").join(after, "part").join(ends.select(F.col("part").alias("next"), "head"), "next")
    return _in_hex(walked.where("not ends").drop("ends", *[c.split()[0] for c in _ENDS.split(", ")]).unionByName(pairs.select("tail_id", "tail", "head").mapInArrow(close, _DONE)))
