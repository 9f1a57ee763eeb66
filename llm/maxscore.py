"""Operator 9: exact top-k search by MaxScore.

The vectors are dealt by hash into shards, and in a shard ordered by halving
them along the dimension that spreads most, so that neighbours are alike. Once
for each shard, postings are written: a dimension makes two terms, one posting
its positive and one its negative components. A query's terms are those whose
sign agrees with it; they alone can raise a score, so query weight times
highest posting bounds what a term can add.

A shard's positions are cut into ranges, each with its own highest and lowest
component of every dimension. A query takes the ranges by falling bound of what their best vector
could score, and none once that is below its threshold, the k-th score so far;
the threshold starts at what a first shard gave and rises as it goes: one range
comes first, then twice as many each time. In them, the terms are split by their bounds: the essential ones are those
without which the other bounds sum to less than the threshold. Their lists are
walked by falling bound and add up the scores (of an essential dimension also
the list that disagrees, which lowers them). Once few vectors can still reach
the threshold they are probed instead, and so they are in the other terms,
while score so far and what is left can reach it; what is left is bounded by
the terms' bounds and by the norms of the components not yet seen. The shards'
answers are merged by a window over each query's few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import vectors as V
from llm.common import settle, unsettle

#: Vectors of a shard, about: each has its own start of the threshold, so few are better.
SHARD = 16_384
#: Positions of a range, and terms between two looks at the threshold.
RANGE = 128
LOOK = 16
#: Vectors of a range are probed rather than met by lists once fewer than this share can reach the threshold.
FEW = 0.9
_POSTED = "width int, shard int, term int, position binary, value binary"
_FOUND = "query_id long, vec_id long, score double, exact string, met long, looked long, ranges long, skipped long"
_FLOAT = 1 << 53
_MOST = 10**38 - 1


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); whole numbers in double precision, which large ones are anyway."""
    return np.floor(v * scale)


def neighbours(d: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order``, rearranged so that each range holds vectors that are near each other: halved along the widest dimension until a range is left."""
    done, open_ = [], [order]
    while open_:
        part = open_.pop()
        if len(part) <= RANGE:
            done.append(part)
            continue
        half = RANGE * -(-len(part) // (2 * RANGE))
        wide = d[part].var(axis=0).argmax()
        part = part[np.argsort(d[part, wide], kind="stable")]
        open_ += [part[half:], part[:half]]
    return np.concatenate(done)


def postings(ids: np.ndarray, d: np.ndarray) -> list[tuple]:
    """(term, positions, values) of a shard; term 0 has the ids, term 2t + 1 the positive and 2t + 2 the negative components of dimension t."""
    order = neighbours(d, np.argsort(ids, kind="stable"))
    ids, d = ids[order], d[order]
    out = [(0, ids.astype(np.int64).tobytes(), b"")]
    for t in range(d.shape[1]):
        for sign in (1, -1):
            at = np.flatnonzero(d[:, t] * sign > 0)
            if len(at):
                out.append((2 * t + 1 + (sign < 0), at.astype(np.int32).tobytes(), d[at, t].tobytes()))
    return out


class Shard:
    """A shard's posting lists by range, each range's highest and lowest components, and the columns that are probed."""

    def __init__(self, rows: pd.DataFrame, dims: int):
        lists = {term: (np.frombuffer(position, np.int32), np.frombuffer(value, np.float64)) for term, position, value in zip(rows["term"], rows["position"], rows["value"], strict=True) if term}
        self.ids = np.frombuffer(rows["position"][rows["term"] == 0].iloc[0], np.int64)
        self.n = len(self.ids)
        self.starts = np.append(np.arange(0, self.n, RANGE), self.n)
        self.columns = np.zeros((dims, self.n))
        self.cut = np.zeros((2 * dims, len(self.starts)), np.int64)
        at, value, before = [np.zeros(0, np.int32)], [np.zeros(0)], 0
        for term, (p, v) in sorted(lists.items()):
            self.columns[(term - 1) // 2, p] = v
            self.cut[term - 1] = before + np.searchsorted(p, self.starts)
            before += len(p)
            at.append(p)
            value.append(v)
        self.at, self.value = np.concatenate(at), np.concatenate(value)
        self.high = np.maximum.reduceat(self.columns, self.starts[:-1], axis=1).T
        self.low = np.minimum.reduceat(self.columns, self.starts[:-1], axis=1).T
        self.square = (self.columns**2).sum(axis=0)
        self.longest = np.sqrt(np.maximum.reduceat(self.square, self.starts[:-1]))

    def walk(self, terms: np.ndarray, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the runs of ranges and values that the terms post, term after term, and how many each posts."""
        first, last = (self.cut[np.ix_(terms, [run[k] for run in runs])] for k in (0, 1))
        spans = [slice(i, j) for i, j in zip(first.ravel().tolist(), last.ravel().tolist(), strict=True)]
        return np.concatenate([self.at[x] for x in spans]), np.concatenate([self.value[x] for x in spans]), (last - first).sum(axis=1)


def _runs(some: list[int]) -> list[tuple[int, int]]:
    """Places [i, j) of a rising list between which each number is one above the last."""
    cut = [0, *(i for i in range(1, len(some)) if some[i] != some[i - 1] + 1), len(some)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def search(s: Shard, x: np.ndarray, own: int, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """ids and scores of the shard's vectors that are among the k best of these and ``held`` (scores found elsewhere).

    Besides: vectors that essential postings met, postings walked and components probed, ranges, ranges skipped.
    """
    agree = 2 * np.arange(len(x)) + (x < 0)
    bounds = np.where(x > 0, x * s.high, x * s.low)  # below 0 where all vectors of a range disagree
    most = np.minimum(bounds.sum(axis=1), np.sqrt(x @ x) * s.longest * (1 + 1e-9) + 1e-6)
    best = np.sort(held)[::-1][:k]
    ids, score, met, looked, skipped = np.zeros(0, np.int64), np.zeros(0), 0, 0, 0
    ranges = np.argsort(-most, kind="stable").tolist()
    nth, many = 0, 1
    while nth < len(ranges):
        least = best[k - 1] if len(best) >= k else -np.inf
        some = sorted(r for r in ranges[nth : nth + many] if most[r] >= least)
        skipped += min(many, len(ranges) - nth) - len(some)
        nth, many = nth + many, 2 * many
        if not some:
            skipped += max(0, len(ranges) - nth)
            break
        runs = [(some[i], some[j - 1] + 1) for i, j in _runs(some)]
        high = bounds[some].max(axis=0)
        order = np.argsort(-high, kind="stable")
        left = np.cumsum(bounds[some][:, order][:, ::-1], axis=1)[:, ::-1]  # of the dimensions from j on, in each range
        left = np.hstack([left, np.zeros((len(some), 1))])
        raised = np.append(np.cumsum(np.maximum(high[order], 0)[::-1])[::-1], 0)  # by postings alone
        norm = np.sqrt(np.append(np.cumsum(x[order][::-1] ** 2)[::-1], 0)) * (1 + 1e-9)
        # without a threshold above 0 every term is essential: a vector that none posts can be among the best
        essential = int(np.searchsorted(-raised, -least, side="right")) if least > 0 else len(order)
        hit = np.concatenate([np.arange(s.starts[a], s.starts[b]) for a, b in runs])
        among, seen = len(hit), np.zeros(s.n, bool)
        hit = hit[s.ids[hit] != own]
        row = np.searchsorted(some, hit // RANGE)
        so_far, rest, j = np.zeros(len(hit)), s.square[hit], 0
        while len(hit) and j < len(order):
            step = order[j : j + LOOK]
            if j < essential and len(hit) > FEW * among:
                step = order[j : min(j + LOOK, essential)]
                at, value, n = s.walk(np.concatenate([agree[step], agree[step] ^ 1]), runs)
                seen[at[: n[: len(step)].sum()]] = True
                so_far = so_far + np.bincount(at, value * np.repeat(np.tile(x[step], 2), n), s.n)[hit]
                rest = rest - np.bincount(at, value * value, s.n)[hit]
                looked += len(at)
            else:
                part = s.columns[step].take(hit, axis=1) if 8 * len(hit) > s.n else s.columns[step[:, None], hit]
                so_far = so_far + x[step] @ part
                rest = rest - np.einsum("ij,ij->j", part, part)
                looked += part.size
            j += len(step)
            if least > -np.inf:
                ok = so_far + np.minimum(left[row, j], norm[j] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6) >= least
                hit, row, so_far, rest = hit[ok], row[ok], so_far[ok], rest[ok]
        met += int(seen.sum())
        if len(hit):
            ids, score = V.top(np.concatenate([ids, s.ids[hit]]), np.concatenate([score, so_far]), k)
            best = np.sort(np.concatenate([held, score]))[::-1][:k]
    if len(best) >= k:
        keep = score >= best[k - 1]
        ids, score = ids[keep], score[keep]
    return ids, score, (met, looked, len(ranges), skipped)


def exact_search(s: Shard, x: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """As ``search``, where double precision can't hold the products: doubles and a bound of their error choose, Python's whole numbers score what is chosen."""
    at = np.flatnonzero(s.ids != own)
    c = s.columns[:, at]
    with np.errstate(over="ignore", invalid="ignore"):
        near, off = x @ c, (len(x) + 2) * np.finfo(float).eps * (np.abs(x) @ np.abs(c))
        sure = np.nan_to_num(near - off, nan=-np.inf)
        least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
        chosen = np.flatnonzero(~(near + off < least))
    q = [int(v) for v in x]
    rows = [[int(v) for v in c[:, i]] for i in chosen]
    found = sorted(zip([-sum(a * b for a, b in zip(q, r, strict=True)) for r in rows], s.ids[at[chosen]].tolist(), strict=True))[:k]
    return np.array([i for _, i in found], np.int64), [max(-_MOST, min(_MOST, -p)) for p, _ in found]


def _found(vectors: DataFrame, every: int, k: int, scale: int, shard: int) -> DataFrame:
    rows = settle(V.usable(vectors, zero=True).select("vec_id", "v", F.size("v").alias("width")))
    candidates = settle(V.of_equal_ones(rows, k))
    n, asked = candidates.count(), rows.where(F.col("vec_id") % every == 0).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // V.QUERIES))
    alone = max(1, -(-asked // (shards * V.QUERIES)))  # blocks of the queries that begin in one shard

    def post(d: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(postings(d["vec_id"].to_numpy(), scaled(V.matrix(d["v"]), scale)), columns=["term", "position", "value"])
        return out.assign(width=np.int32(d["width"].iloc[0]), shard=np.int32(d["shard"].iloc[0]))[["width", "shard", "term", "position", "value"]]

    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    posted = settle(candidates.withColumn("shard", home).groupBy("width", "shard").applyInPandas(post, _POSTED))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "width", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int").alias("first"))

    def task(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(d):
            s = Shard(d, int(d["width"].iloc[0]))
            u = scaled(V.matrix(q["v"]), scale)
            high = np.abs(s.columns).max(initial=0)
            for x, own, held in zip(u, q["query_id"], q["held"], strict=True):
                if max(high, np.abs(x).max(initial=0)) ** 2 * len(x) < _FLOAT:
                    ids, score, did = search(s, x, own, k, np.asarray(held, float))
                    out += [(own, i, float(v), None, 0, 0, 0, 0) for i, v in zip(ids.tolist(), score.tolist(), strict=True)]
                else:
                    ids, whole = exact_search(s, x, own, k)
                    did = (s.n, s.columns.size, len(s.starts) - 1, 0)
                    out += [(own, i, float(v), str(v), 0, 0, 0, 0) for i, v in zip(ids.tolist(), whole, strict=True)]
                out.append((own, None, None, None, *did))
        got = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "exact", "met", "looked", "ranges", "skipped"], dtype=object)
        return got.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "met": "int64", "looked": "int64", "ranges": "int64", "skipped": "int64"})

    def round_(asked: DataFrame, blocks: int) -> DataFrame:
        """asked: query_id, v, width, shard, held."""
        asked = asked.withColumn("block", V.block_of("query_id", blocks))
        data = posted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return settle(asked.groupBy("width", "shard", "block").cogroup(data.groupBy("width", "shard", "block")).applyInPandas(task, _FOUND))

    seen = [rows, candidates, posted]
    first = round_(queries.select("query_id", "v", "width", F.col("first").alias("shard"), F.array().cast("array<double>").alias("held")), alone)
    if shards == 1:
        return _done(first, seen)
    held = V.threshold_of(V.best_of(first.where("vec_id is not null and exact is null"), k), k)
    others = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> first").drop("first")
    rest = round_(others.join(held, "query_id", "left").select("query_id", "v", "width", "shard", F.coalesce("held", F.array().cast("array<double>")).alias("held")), blocks)
    return _done(first.unionByName(rest), seen)


def _done(found: DataFrame, used: list[DataFrame]) -> DataFrame:
    for df in used:
        unsettle(df)
    return found


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    vectors: vec_id, embedding. A component x counts as floor(scale * x). Rows
    whose id is divisible by ``every`` are queries; all rows but the query's
    own are candidates. Ties go to the smaller vec_id. Null vectors and those
    with null or non-finite components take no part, nor do null ids; vectors
    of different lengths don't meet. An empty table gives no rows. Rows that
    share a query's id are no candidates of it; several query rows of one id
    have one ranking together, in which a candidate comes once for each. Large
    components are multiplied in whole numbers of any size; a score among the k
    that a long can't hold is an error, as it has no right value.
    """
    found = _found(vectors, every, k, scale, shard).where("vec_id is not null")
    exact = F.coalesce(F.col("exact").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    return V.best_of(found.select("query_id", "vec_id", exact.alias("score")), k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def work(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard: int = SHARD) -> dict[str, float]:
    """Of all pairs of a query and a candidate: the share that essential postings met, and the share of components looked at; of all pairs of a query and a range, the share skipped."""
    rows = V.usable(vectors, zero=True)
    n, asked, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.avg(F.size("v"))).first()
    met, looked, ranges, skipped = _found(vectors, every, k, scale, shard).agg(F.sum("met"), F.sum("looked"), F.sum("ranges"), F.sum("skipped")).first()
    pairs = max(1, n * asked)
    return {"met": (met or 0) / pairs, "looked": (looked or 0) / pairs / (width or 1), "skipped": (skipped or 0) / (ranges or 1)}
