"""Operator 2: conflict-constrained best-fit packing.

Documents are packed into bins of ``capacity`` words. A bin's residual must fit
the document, and its bitmaps of sources and duplicate clusters must not clash
with it: no two documents of one cluster meet in a bin, and a source fills at
most ``per_source`` of its places. Open bins are ordered by residual; from the
first residual that fits, the successors are searched until one is compatible,
which is the tightest. Bins are packed in shards of about ``SHARD`` documents
in decreasing order of size, each shard by itself, so memory is bounded and a
hot source or cluster is spread over all shards.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import WORD, n_words, settle, small_batches
from llm.jaccard_join import text_key

#: Words of a bin, documents of a source that may share one, documents of a shard (about).
CAPACITY = 4096
PER_SOURCE = 4
SHARD = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each document, in the order given; sizes from 1 to capacity."""
    source_bit = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: k for k, c in enumerate(dict.fromkeys(clusters))}
    open_: list[tuple[int, int]] = []  # residual, bin
    source_map: list[list[int]] = []  # of a bin: for each of per_source layers, a bitmap of sources
    cluster_map: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source_bit[source], 1 << cluster_bit[cluster]
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            b = open_[at][1]
            if not cluster_map[b] & c and not source_map[b][-1] & s:
                break
            at += 1
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = capacity, len(cluster_map)
            cluster_map.append(0)
            source_map.append([0] * per_source)
        cluster_map[b] |= c
        layers = source_map[b]
        layers[next(k for k in range(per_source) if not layers[k] & s)] |= s
        if room > size:
            insort(open_, (room - size, b))
        out.append(b)
    return out


_WORD = re.compile(WORD)


def cut(text: str, capacity: int) -> list[str]:
    """The text in parts of ``capacity`` words, the last one shorter, each with the white space behind its words; on end they are the text."""
    at, found = [0], 0
    for m in _WORD.finditer(text):
        if found and found % capacity == 0:
            at.append(m.start())
        found += 1
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, cluster: str | None = None, alike: DataFrame | None = None, text: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text, source) placed in bins.

    A text of more than ``capacity`` words fills bins of its own and its last
    part is packed like a document, so there is one row for each part: doc_id,
    part (from 0), size (words of the part), source, cluster, bin (its shard and
    number), bin_start (words before it in the bin), and with ``text`` the part's
    text. ``cluster`` names a column with the duplicate cluster; without it, texts
    with the same words (A-Z lower-cased) are one cluster. ``alike`` has classes
    of near copies instead, as ``jaccard_join.text_classes`` gives them. Null and
    empty texts have one part of size 0 in no bin (null). A null source is a
    source of its own. Rows of one id, or of none, are dealt and packed one by
    one; rows alike in everything are each other's copies and so never share a
    bin. An empty table gives no rows.
    """
    spark = docs.sparkSession
    same = F.xxhash64(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")))
    key = text_key() if alike is not None else F.xxhash64(cluster) if cluster else same
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("words"), key.alias("cluster"), F.monotonically_increasing_id().alias("row"), *[F.col("text")][:text])
    if text:
        small_batches(spark)
        total = docs.count()
    else:
        rows = settle(rows)
        total = rows.count()
    if alike is not None:
        rows = rows.join(alike, F.col("cluster") == F.col("key"), "left").withColumn("cluster", F.coalesce("component", "cluster"))
    shards = max(1, -(-total // shard))
    # by the row's number, so that no id, source or cluster fills a shard
    dealt = rows.select("doc_id", "source", "words", "cluster", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), *["text"][:text])
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    fields = [("doc_id", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("bin", pa.string()), ("bin_start", pa.int64()), *[("text", pa.string())][:text]]
    schema = pa.schema(fields)

    def packed(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = []
        for doc_id, source, words, same, _, *texts in held:
            n = max(1, -(-words // capacity))
            pieces = cut(texts[0], capacity) if n > 1 and texts else texts * n if n == 1 else [None] * n
            parts += [(doc_id, k, min(capacity, words - k * capacity), source, same, *pieces[k : k + 1][:text]) for k in range(n)]
        parts.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[4]))
        some = [r for r in parts if r[2]]
        bins = best_fit([r[2] for r in some], [r[3] for r in some], [r[4] for r in some], capacity, per_source)
        filled: dict[int, int] = {}
        out, load = [], 0
        for r, b in zip(parts, [*bins, *[None] * (len(parts) - len(bins))], strict=True):
            start = filled.get(b, 0) if b is not None else 0
            if b is not None:
                filled[b] = start + r[2]
            out.append((*r[:5], None if b is None else f"{number}-{b}", start, *r[5:]))
            load += len(r[5] or "") if text else 0
            if len(out) >= 5000 or load >= 1 << 24:
                yield _batch(out)
                out, load = [], 0
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][4] != row[4]:
                    yield from packed(held[0][4], held)
                    held = []
                held.append(row)
        if held:
            yield from packed(held[0][4], held)

    sent = dealt.repartition(count, "shard").sortWithinPartitions("shard")
    kind = "doc_id long, part int, size long, source string, cluster long, bin string, bin_start long" + ", text string" * text
    return sent.mapInArrow(place, kind)
