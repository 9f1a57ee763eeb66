"""Operator 6: grouped prefix join on n-gram Jaccard similarity.

The plan, over documents reduced to their sets of distinct word shingles:

1. ``heavy_shingles``: one pass counts shingles with mergeable Misra-Gries
   summaries of fixed size. They only fix the order of shingles (rare first),
   so their error never changes a result, only how many candidates there are.
2. ``signatures``: each document's set size, set digest and prefix. With the
   threshold t and a set of n, the prefix holds the first
   ``n - ceil(t n) + l`` shingles of the order; two sets at least t alike share
   at least ``min(l, ceil(t n))`` of them. Documents of the same prefix and
   size form one group, which goes through the filter once.
3. ``candidate_edges``: an inverted index over the groups' prefixes. Lists of
   up to ``SHORT`` groups give pairs, of which those with enough common
   prefix shingles and compatible sizes stay; longer lists (large families of
   near copies) give one edge from each group to the list's first group, never
   all pairs. What is connected is a family.
   ``refined``: shingles that are too frequent for short lists and too rare for
   the summary can chain unlike documents into one large family. Families of
   more than ``REFINED`` blocks are filtered once more, in the exact order of
   counts within the family, which lets go of all but what is alike.
4. ``verified_links``: the families' members are expanded and verified on
   their whole texts, in blocks of bounded size, every pair of blocks of a
   family in a task of its own. A task only returns the links that connect
   something, so a family of thousands gives thousands of links.
5. Components of the links, by ``connected_components``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import WORD, scratch, settle, small_batches, unsettle
from llm.components import connected_components
from llm.shingles import mix, shingle_sets

#: Counters of a Misra-Gries summary: 3 MB, whatever the input.
COUNTERS = 1 << 18
#: Parts of the hash space that are merged on their own.
RANGES = 64
#: Common prefix shingles that a candidate pair needs (fewer for tiny sets).
COMMON = 4
#: Longest inverted list that is turned into pairs.
SHORT = 32
#: Shingles of a family's block, about; two blocks meet in a task.
BLOCK = 1 << 19
#: Blocks of a family above which its exact order is worth two more shuffles of its shingles.
REFINED = 8
#: Rows of a table of ids up to which it is sent to the texts; beyond, the texts are shuffled to meet it.
SENT = 500_000
#: Bits of the filter that spares most texts the way to the families.
BITS = 1 << 24


def _prune(h: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The Misra-Gries step: the counts above the (most + 1)-th highest, less that count."""
    if len(h) <= most:
        return h, c
    cut = np.partition(c, len(c) - most - 1)[len(c) - most - 1]
    keep = c > cut
    return h[keep], c[keep] - cut


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return h, np.bincount(inverse, np.concatenate([x for _, x in parts]), len(h)).astype(np.int64)


def heavy_shingles(docs: DataFrame, width: int, counters: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the frequent shingles of the column text: at most ``counters`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, fresh, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def fold(summary):
            h, c = np.unique(np.concatenate(fresh), return_counts=True) if fresh else summary
            h, c = _merge([summary, (h, c)]) if fresh else summary
            return _prune(h, c, 4 * counters)

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                fresh.append(s)
                size += len(s)
            if size > 1 << 21:
                kept, fresh, size = fold(kept), [], 0
        h, c = fold(kept)
        h, c = _prune(h[c > 1], c[c > 1], counters)  # what a task saw once is not frequent
        part = (h >> np.uint64(58)).astype(np.int64)  # ascending, as h is
        at = np.searchsorted(part, np.arange(RANGES + 1))
        rows = [(k, h[a:b].tobytes(), c[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "h", "c"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                new = (np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64))
                held[part] = _prune(*_merge([held[part], new]), 4 * counters // RANGES) if part in held else new
        rows = [(part, *_prune(*x, counters // RANGES)) for part, x in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["part", "h", "c"])

    kind = "part int, h binary, c binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition(RANGES, "part").mapInArrow(merge, kind).collect()
    rows.sort(key=lambda r: r.part)
    h = np.concatenate([np.frombuffer(r.h, np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(r.c, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(h)
    return h[order], c[order]


def _prefix(s: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` shingles in the order (weight, hash), by hash."""
    if length >= len(s):
        return s
    rare = np.flatnonzero(weight == 0)
    if len(rare) >= length:
        return s[rare[:length]]
    rest = np.flatnonzero(weight)
    rest = rest[np.argsort(weight[rest], kind="stable")][: length - len(rare)]
    return s[np.sort(np.concatenate([rare, rest]))]


def _weighed(flat: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The summary's count of each shingle, 0 for those that it doesn't have."""
    high, count = heavy
    if not len(high) or not len(flat):
        return np.zeros(len(flat), np.int64)
    at = np.minimum(np.searchsorted(high, flat), len(high) - 1)
    return np.where(high[at] == flat, count[at], 0)


def _prefix_length(n: int, num: int, den: int) -> int:
    need = -(-num * n // den)
    return n - need + min(COMMON, need)


def signatures(docs: DataFrame, width: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, digest of the set, group (digest of prefix and size), prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            weight = _weighed(np.concatenate(sets) if sets else np.zeros(0, np.uint64), shared.value)
            n, digest, group, prefix, begin = [], [], [], [], 0
            for s in sets:
                m = len(s)
                n.append(m)
                if m:
                    p = _prefix(s, weight[begin : begin + m], _prefix_length(m, num, den)).tobytes()
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    group.append(hashlib.blake2b(p + m.to_bytes(8, "little"), digest_size=16).digest())
                    prefix.append(p)
                    begin += m
                else:
                    digest.append(None)
                    group.append(None)
                    prefix.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(group, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "digest", "grp", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, digest binary, grp binary, prefix binary")


_POSTING = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4")])


def _dealt(records: np.ndarray, key: np.ndarray, parts: int) -> pa.RecordBatch:
    """The records in one packed row for each part that their keys fall into."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    found, at = np.unique(part, return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([x.tobytes() for x in np.split(records, at[1:])], pa.binary())], names=["part", "postings"])


def candidate_edges(groups: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Edges a, b between the groups (gid, n, prefix) that may hold documents alike."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, n, prefix = (x.to_pylist() for x in batch.columns)
            if not gid:
                continue
            length = np.array([len(p) // 8 for p in prefix])
            all_ = np.empty(length.sum(), _POSTING)
            all_["token"] = np.frombuffer(b"".join(prefix), np.uint64)
            all_["gid"] = np.repeat(np.array(gid, np.int64), length)
            all_["n"] = np.repeat(np.array(n, np.int64), length)
            yield _dealt(all_, all_["token"], parts)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(x, _POSTING) for batch in batches for x in batch.column(1).to_pylist()]
        if not got:
            return
        p = np.concatenate(got)
        del got
        p = p[np.argsort(p["token"], kind="stable")]
        edge = np.flatnonzero(np.r_[True, p["token"][1:] != p["token"][:-1], True])
        start, size = edge[:-1], np.diff(edge)

        def row(a, b, far, need):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far, pa.bool_()), pa.array(need, pa.int64())], names=["a", "b", "far", "need"])

        for m in range(2, SHORT + 1):
            s = start[size == m]
            if not len(s):
                continue
            i, j = np.triu_indices(m, 1)
            for some in np.array_split(s, max(1, len(s) * len(i) // 200_000)):
                x, y = p[(some[:, None] + i).ravel()], p[(some[:, None] + j).ravel()]
                low, high = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
                ok = (den * low >= num * high) & (x["gid"] != y["gid"])
                x, y, low = x[ok], y[ok], low[ok]
                yield row(np.maximum(x["gid"], y["gid"]), np.minimum(x["gid"], y["gid"]), np.zeros(len(x), bool), np.minimum(COMMON, -(-num * low // den)))
        for s, m in zip(start[size > SHORT], size[size > SHORT], strict=True):
            g = np.unique(p["gid"][s : s + m])
            yield row(g[1:], np.full(len(g) - 1, g[0]), np.ones(len(g) - 1, bool), np.zeros(len(g) - 1, np.int64))

    dealt = groups.select("gid", "n", "prefix").mapInArrow(deal, "part long, postings binary")
    pairs = dealt.repartition(parts, "part").mapInArrow(pair, "a long, b long, far boolean, need long")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.max("far").alias("far"), F.min("need").alias("need")).where("far or common >= need").select("a", "b")


def _flagged(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """docs with the boolean __maybe: whether its doc_id (or column ``by``) may be among ids. A filter of fixed size that misses none of them."""
    bit = F.pmod(F.xxhash64(by), F.lit(BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["word"].to_numpy(int)] = words["mask"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    kind = T.StructType([*docs.schema.fields, T.StructField("__maybe", T.BooleanType())])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            b = batch.column(batch.num_columns - 1).to_numpy()
            ok = (have[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ok.astype(bool))], names=[*batch.schema.names[:-1], "__maybe"])

    return docs.withColumn("__bit", bit).mapInArrow(flag, kind)


def _small(ids: DataFrame) -> DataFrame:
    """ids, sent to every task of a join if it has at most ``SENT`` rows; ids is a written table, so counting it costs little."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


#: spare: how many of the document's most frequent shingles its prefix does without; df: 0 where it is to be counted.
_COUNTED = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("spare", "<u4"), ("df", "<u4")])
_FIXED = np.iinfo(np.uint32).max


def refined(docs: DataFrame, members: DataFrame, width: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """members (doc_id, family, n) in the smaller families that remain of theirs; those without a candidate are left out.

    Within a family, the shingles that the summary doesn't have are counted
    exactly and come first, rare ones first; then those of the summary. A
    shingle that only one member has meets nothing and is only numbered. What
    the summary has never goes to its counting task, so no task's lists are
    longer than the summary's error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    kind = "part long, postings binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, family = (x.to_pylist() for x in batch.columns)
            sets = shingle_sets(texts, width)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if not len(flat):
                continue
            weight, length = _weighed(flat, shared.value), np.array([len(s) for s in sets])
            all_ = np.empty(len(flat), _COUNTED)
            # a token of the family's own, so that families don't meet
            all_["token"] = mix(flat ^ np.repeat(mix(np.array(family, np.int64).view(np.uint64)), length))
            all_["gid"] = np.repeat(np.array(ids, np.int64), length)
            all_["n"] = np.repeat(length, length)
            all_["df"] = np.where(weight > 0, _FIXED, 0)
            keep, begin = weight == 0, 0
            for m in length.tolist():
                some, want = slice(begin, begin + m), _prefix_length(m, num, den)
                rare = int(keep[some].sum())
                all_["spare"][some] = max(0, rare - want)
                if want > rare:  # all rare ones are in the prefix, and of the others the first
                    rest = begin + np.flatnonzero(weight[some])
                    keep[rest[np.argsort(weight[rest], kind="stable")][: want - rare]] = True
                begin += m
            all_ = all_[keep]
            yield _dealt(all_, np.where(all_["df"] > 0, all_["gid"].view(np.uint64), all_["token"]), parts)

    def gathered(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.concatenate([np.zeros(0, _COUNTED), *[np.frombuffer(x, _COUNTED) for batch in batches for x in batch.column(1).to_pylist()]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gathered(batches)
        fixed, p = p[p["df"] > 0], p[p["df"] == 0]
        p = p[np.argsort(p["token"], kind="stable")]
        edge = np.flatnonzero(np.r_[True, p["token"][1:] != p["token"][:-1], True]) if len(p) else np.zeros(1, np.int64)
        size = np.diff(edge)
        p["df"] = np.repeat(np.minimum(size, _FIXED - 1), size)
        p = np.concatenate([fixed, p[p["df"] > 1]])
        for some in np.array_split(p, len(p) // 1_000_000 + 1):
            if len(some):
                yield _dealt(some, some["gid"].view(np.uint64), parts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gathered(batches)
        p = p[np.lexsort((p["token"], p["df"], p["spare"], p["n"], p["gid"]))]
        owner = p[["gid", "n", "spare"]]
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(p) else np.zeros(1, np.int64)
        # of the shingles met elsewhere, those before the spare ones; texts of one doc_id and size only make the prefix longer
        rows = [(int(p["gid"][a]), int(p["n"][a]), p["token"][a : b - int(p["spare"][a])].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > int(p["spare"][a])]
        for at in range(0, len(rows), 10_000):
            gid, n, found = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["gid", "n", "prefix"])

    texts = _flagged(docs.where("doc_id is not null").select("doc_id", "text"), members.select("doc_id")).where("__maybe").join(members.select("doc_id", "family").distinct(), "doc_id")
    counted = texts.select("doc_id", "text", "family").mapInArrow(deal, kind).repartition(parts, "part").mapInArrow(count, kind)
    prefixes = settle(counted.repartition(parts, "part").mapInArrow(prefix, "gid long, n long, prefix binary"))
    found = connected_components(candidate_edges(prefixes, num, den, parts))
    out = settle(members.join(found, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("family"), "n").distinct())
    unsettle(prefixes)
    return out


def _links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect documents alike; within one block (all sides 0) any pair counts, else pairs across sides."""
    token, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(inverse, kind="stable")
    df = np.bincount(inverse, minlength=len(token))
    at = np.concatenate([[0], np.cumsum(df)])
    docs_of, begin = owner[order], np.concatenate([[0], np.cumsum(size)])
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    across, out = bool(side.any()), []
    for i in range(len(sets)):
        t = inverse[begin[i] : begin[i + 1]]
        t = t[df[t] > 1]
        if not len(t):
            continue
        runs = df[t]
        where = np.repeat(at[t] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        both = np.bincount(docs_of[where], minlength=len(sets))
        alike = den * both >= num * (size + size[i] - both)
        alike[: i + 1] = False
        if across:
            alike &= side != side[i]
        for j in np.flatnonzero(alike):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def verified_links(docs: DataFrame, members: DataFrame, width: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links a, b between the members (doc_id, family, n) whose texts are alike."""
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
    placed = settle(members.join(blocks, "family").select("doc_id", "family", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block")))
    texts = _flagged(docs.where("doc_id is not null").select("doc_id", "text"), placed.select("doc_id")).where("__maybe").join(_small(placed), "doc_id")
    pairs = texts.select("doc_id", "text", "family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = pairs.select("doc_id", "text", "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    # a document meets its own block where low = high
    sent = sent.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, int, str, int]] = []

        def flush(rows) -> pa.RecordBatch:
            sets = shingle_sets([r[2] for r in rows], width)
            out, i = [], 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][0] == rows[i][0]:
                    j += 1
                some = [k for k in range(i, j) if len(sets[k])]
                if len(some) > 1:
                    low = rows[i][0][1]
                    out += _links(np.array([rows[k][1] for k in some], np.int64), np.array([rows[k][3] != low for k in some]), [sets[k] for k in some], num, den)
                i = j
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            doc, text, family, low, high, block = (batch.column(k).to_pylist() for k in range(6))
            held += [((f, a, b), d, t, k) for d, t, f, a, b, k in zip(doc, text, family, low, high, block, strict=True)]
            last = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != held[-1][0]), -1) + 1
            if last:
                yield flush(held[:last])
                held = held[last:]
        if held:
            yield flush(held)

    return sent.mapInArrow(verify, "a long, b long")


def text_key() -> F.Column:
    """What tells rows apart by doc_id and text; texts without a word count as none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(WORD), F.col("text")))


def text_classes(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Classes of ``ngram_jaccard_components`` among rows by their own texts, whatever ids they share or lack.

    Returns one row for each ``text_key`` that is linked to another or that
    several rows have: key, component (smallest key of its class), n (rows).
    """
    keyed = docs.select(text_key().alias("doc_id"), "text")
    again = settle(keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    repeats = not again.isEmpty()
    if repeats:
        # one row of each key, so that rows alike in everything aren't compared among themselves
        flagged = _flagged(keyed, again)
        once = flagged.where("__maybe").groupBy("doc_id").agg(F.max("text").alias("text"))
        keyed = settle(flagged.where("not __maybe").select("doc_id", "text").unionByName(once))
    found = ngram_jaccard_components(keyed, width, num, den).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).where("key <> component")
    linked = found.unionByName(found.select(F.col("component").alias("key"), "component").distinct())
    if not repeats:
        return settle(linked.withColumn("n", F.lit(1).cast("long")))
    both = linked.join(again.withColumnRenamed("doc_id", "key"), "key", "full")
    return settle(both.select("key", F.coalesce("component", "key").alias("component"), F.coalesce("n", F.lit(1)).cast("long").alias("n")))


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs that stay when each class of ``text_classes`` keeps the one of its smallest doc_id.

    Each row is judged by its own text, whatever id it shares or lacks; null ids
    come last. Of rows alike in id and text one stays. A text without words is
    like no other, so of such rows only those of one id are each other's copies.
    """
    classes = text_classes(docs, width, num, den)
    keys = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("id")).join(classes.select("key", "component"), "key")
    first = settle(keys.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("component", F.col("first.key").alias("stays")))
    # most rows are in no mark; they pass a filter and needn't be shuffled with their texts
    marks = settle(classes.join(_small(first), "component").select(F.col("key").alias("__key"), F.col("n").alias("__n"), (F.col("key") != F.col("stays")).alias("__drop")))
    flagged = _flagged(docs.withColumn("__key", text_key()), marks, "__key")
    rest = flagged.where("__maybe").join(_small(marks), "__key", "left").where("not coalesce(__drop, false)")
    out = flagged.where("not __maybe").select(*docs.columns).unionByName(rest.where("coalesce(__n, 1) = 1").select(*docs.columns))
    if marks.where("__n > 1 and not __drop").isEmpty():
        return out
    again = rest.where("__n > 1").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(again.select("row.*"))


def ngram_jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, block: int = BLOCK, counters: int = COUNTERS) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of word shingles of at least num / den.

    docs: doc_id (long), text; other columns are ignored. Returns one row per
    row: doc_id, n_shingles (size of its set), component_id (smallest doc_id
    reachable by links, its own if none). A null or empty text has no shingle
    and no link. A text shorter than ``width`` words is one shingle. Rows of a
    null doc_id come back with a null component and link with nothing; rows of
    one doc_id share a component. An empty table gives an empty result.
    ``block`` and ``counters`` change the work, never the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark) as keep:
        return keep(_components(docs, width, num, den, block, counters))


def _components(docs: DataFrame, width: int, num: int, den: int, block: int, counters: int) -> DataFrame:
    spark = docs.sparkSession
    heavy = heavy_shingles(docs, width, counters)
    signed = settle(signatures(docs, width, num, den, heavy))
    named = signed.where("n > 0 and doc_id is not null")
    groups = settle(named.groupBy("grp").agg(F.min("doc_id").alias("gid"), F.min("n").alias("n"), F.min("prefix").alias("prefix"), (F.min("digest") != F.max("digest")).alias("mixed")))
    postings = groups.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings // 2_000_000) + 1)
    families = settle(connected_components(candidate_edges(groups, num, den, parts)))
    near = groups.join(families, groups.gid == families.node, "left").where("mixed or component is not null").select("grp", F.coalesce("component", "gid").alias("family"))
    # one member for each distinct set; equal sets are linked without looking
    sets = named.groupBy("grp", "digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    members = settle(sets.join(near, "grp").select(F.col("rep").alias("doc_id"), "family", "n").distinct())
    loads = members.groupBy("family").agg(F.sum("n").alias("load"), F.count("*").alias("size")).where("size > 1")
    large = settle(loads.where(F.col("load") > REFINED * block).select("family", "load"))
    wide = large.agg(F.sum("load")).first()[0]
    if wide:
        more = max(parts, int(wide // 2_000_000) + 1)
        fine = refined(docs, members.join(large, "family", "left_semi"), width, num, den, heavy, more)
        members = members.join(large, "family", "left_anti").unionByName(fine)
    links = settle(verified_links(docs, members, width, num, den, block))
    copies = named.join(sets.select("digest", "rep"), "digest")
    ids = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.unionByName(ids))
    sized = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return settle(sized.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
