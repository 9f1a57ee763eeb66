"""Facts of different sources met by the characters they hold: the work of two blocks in a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sets that are met at once, of one block by those of another.
TILE, FEW = 2048, 16
#: Confidences of a block are taken in so many runs at most.
RUNS = 128
#: Times that a row is added instead of multiplied.
OFTEN = 8


def letters(text: Column) -> Column:
    """The distinct characters of a text, in order."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(sorted(set(t))))

    return of(text)


def _dealt(at: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places that count n times each: as lists, no longer than a byte can count, of those of few times, and the others."""
    few = np.repeat(at, np.where(n <= OFTEN, n, 0))
    return [few[k : k + 255] for k in range(0, len(few), 255)], at[n > OFTEN], n[n > OFTEN]


def _summed(hits: np.ndarray, few: list[np.ndarray], at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rows of hits (true or not) at the places of ``_dealt``, added up."""
    out = np.zeros(hits.shape[1])
    for k in few:
        out += np.add.reduce(hits[k], axis=0, dtype=np.uint8)
    for k in range(0, len(at), 255):
        out += n[k : k + 255].astype(float) @ hits[at[k : k + 255]]
    return out


def _groups(*keys: np.ndarray) -> list[slice]:
    """The runs of rows, sorted by the keys, that have them all alike."""
    new = np.any([np.diff(k) != 0 for k in keys], axis=0)
    ends = [0, *(np.flatnonzero(new) + 1), len(keys[0])] if len(keys[0]) else [0]
    return [slice(x, y) for x, y in zip(ends, ends[1:], strict=False)]


class _Sets:
    """Sets of characters, as bits, and the rows of facts (the set's place, source, confidence, n) that have them."""

    def __init__(self, g: pd.DataFrame):
        # half a character, which no text holds, stands for a text without any
        chars = [c or "\ud800" for c in g["chars"]]
        self.size = np.array([len(c) for c in chars])
        seen, at = np.unique(np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        words, ends = -(-len(seen) // 64), np.concatenate([[0], np.cumsum(self.size)])
        self.bits = np.empty((words, len(g)), np.uint64)
        for k in range(0, len(g), TILE):
            few = self.size[k : k + TILE]
            member = np.zeros((len(few), 64 * words), bool)
            member[np.repeat(np.arange(len(few)), few), at[ends[k] : ends[k + len(few)]]] = True
            self.bits[:, k : k + TILE] = np.packbits(member, axis=1, bitorder="little").view(np.uint64).T
        self.of = np.repeat(np.arange(len(g)), g["n"].map(len))
        self.source, self.name = pd.factorize(np.concatenate(g["source"].to_list()), sort=True)
        self.conf, self.n = np.concatenate(g["confidence"].to_list()), np.concatenate(g["n"].to_list())
        self.sure = np.zeros(len(g), bool)
        self.sure[self.of[self.conf > 0.7]] = True

    def rows(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some sets, and the place of each one's set among these."""
        place = np.full(len(self.size), -1)
        place[sets] = np.arange(len(sets))
        r = np.flatnonzero(place[self.of] >= 0)
        return r, place[self.of[r]]

    def weights(self, r: np.ndarray, at: np.ndarray, n: np.ndarray, sets: int) -> np.ndarray:
        """The rows' n by set and source."""
        names = len(self.name)
        return np.bincount(at * names + self.source[r], n, sets * names).reshape(sets, names)

    def alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of y agrees with each of x (sure ones only), and whether they conflict but for their confidences. x has the sure ones first, y lies by size, then the same way."""
        size, nx, kind = self.size[x], int(self.sure[x].sum()), np.uint8 if len(self.bits) < 4 else np.uint32
        agree, conflict, bits = np.zeros((len(y), nx), bool), np.empty((len(y), len(x)), bool), np.take(self.bits, x, 1)
        shared, ones, counts, under = (np.empty((FEW, len(x)), k) for k in (np.uint64, np.uint8, kind, bool))
        for same in _groups(self.size[y]):
            # whole numbers: similarity is both / (total - both), so over 0.5 it is 3 both > total
            total = size + self.size[y[same.start]]
            half, least, most = ((part // by).astype(kind) for part, by in ((total[:nx], 3), (3 * total, 23), (2 * total, 7)))
            for k in range(same.start, same.stop, FEW):
                few = y[k : min(k + FEW, same.stop)]
                m, n = len(few), int(self.sure[few].sum())
                both, one, held = counts[:m], ones[:m], conflict[k : k + m]
                both[:] = 0
                for v, w in zip(self.bits[:, few], bits, strict=True):
                    both += np.bitwise_count(np.bitwise_and(v[:, None], w, out=shared[:m]), out=one)
                np.less_equal(both, most, out=held)
                held &= np.greater(both, least, out=under[:m])
                np.greater(both[:n, :nx], half, out=agree[k : k + n])
        return agree, conflict


def compared(g: pd.DataFrame, second: np.ndarray) -> pd.DataFrame:
    """Pairs of facts of each two sources that agree and that conflict, over the sets (chars, and source, confidence and n of their rows) of two blocks or, when none is of the second, of one."""
    if not len(g):
        return pd.DataFrame({"source_a": [], "source_b": [], "agreeing": [], "conflicting": []})
    s, every = _Sets(g), np.arange(len(g))
    a, b = (every[~second], every[second]) if second.any() else (every, every)
    a, b = a[np.argsort(~s.sure[a], kind="stable")], b[np.lexsort((~s.sure[b], s.size[b]))]
    r, at = s.rows(b)
    values = np.array_split(v := np.unique(s.conf[r]), max(1, min(len(v), RUNS)))
    run = np.searchsorted([v[0] for v in values], s.conf[r], "right") if len(r) else r
    r, at, run = (k[np.lexsort((s.source[r], run))] for k in (r, at, run))
    runs = _groups(run)
    sure = np.flatnonzero(s.conf[r] > 0.7)
    sure = sure[np.argsort(s.source[r[sure]], kind="stable")]
    agreeing = [(s.source[r[k[0]]], _dealt(at[k], s.n[r[k]])) for k in (sure[k] for k in _groups(s.source[r[sure]]))]
    conflicting = [[(s.source[r[k][0]], _dealt(at[k], s.n[r[k]])) for k in (np.arange(of.start, of.stop)[k] for k in _groups(s.source[r[of]]))] for of in runs]
    found = np.zeros((2, len(s.name), len(s.name)))
    for x in (a[k : k + TILE] for k in range(0, len(a), TILE)):
        agree, conflict = s.alike(x, b)
        q, place = s.rows(x)
        conf, n = s.conf[q], s.n[q]
        mine = s.weights(q, place, n * (conf > 0.7), len(x))[: agree.shape[1]]
        for name, places in agreeing:
            found[0][:, name] += _summed(agree, *places) @ mine
        for those, of, named in zip(values, runs, conflicting, strict=False):
            # a row far from either end of a run, and not inside, is far from all of it; near both, it is near all
            low, high = (np.abs(conf - c) > 0.2 for c in (those[0], those[-1]))
            far = low & high & ((conf <= those[0]) | (conf >= those[-1]))
            open_ = ~far & (low | high)
            mine = s.weights(q, place, n * far, len(x))
            for name, places in named if far.any() else ():
                found[1][:, name] += _summed(conflict, *places) @ mine
            for k in range(of.start, of.stop, TILE) if open_.any() else ():
                k = slice(k, min(k + TILE, of.stop))
                apart = conflict[at[k]][:, place[open_]] & (np.abs(s.conf[r[k], None] - conf[open_]) > 0.2)
                theirs = s.weights(r[k], np.arange(k.stop - k.start), s.n[r[k]], k.stop - k.start)
                found[1] += s.weights(q[open_], np.arange(open_.sum()), n[open_], int(open_.sum())).T @ (apart.T @ theirs)
    # within one block every pair is met from both ends
    found = found + found.transpose(0, 2, 1) if second.any() else found
    p, q = np.nonzero(np.triu(found.any(axis=0), 1))
    return pd.DataFrame({"source_a": s.name[p], "source_b": s.name[q], "agreeing": found[0][p, q].astype(np.int64), "conflicting": found[1][p, q].astype(np.int64)})
