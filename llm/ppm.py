"""Operator 7: language by prediction by partial matching.

For each language a context tree over bytes, of contexts of 0 to ``ORDER``
bytes, is counted from a bounded sample of labelled texts and then frozen. A
byte's probability under a context is its count over (total + distinct); with
what is left, distinct / (total + distinct), the model escapes to the context
one byte shorter, where bytes already seen are excluded. The last escape is to
equal chances for all bytes. So every context's probabilities sum to 1 and the
summed -log2 is an exact code length. A text gets the language with the
shortest code.

The frozen trees become one table of code lengths by context and byte, so
scoring is two array look-ups a byte for all languages at once, over whole
texts in pieces of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches

#: Bytes of the longest context.
ORDER = 3
#: Texts of a language that its tree is fitted on, at most.
TEXTS = 300
_PIECE = 1 << 20
_PAD = b"\n" * ORDER


def _counts(texts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each lang, the distinct runs of ORDER + 1 bytes, as numbers, and their counts."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(_PAD + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
                code = b[: len(b) - 3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
                for g, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                    of = held.setdefault(lang, {})
                    of[g] = of.get(g, 0) + n
        rows = [(lang, g, n) for lang, of in held.items() for g, n in of.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    found = texts.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (x.gram.to_numpy(np.int64), x.n.to_numpy(np.int64)) for lang, x in found.groupby("lang")}


class Trees:
    """Frozen code lengths: ``symbol`` numbers the bytes, ``row`` finds a context's row, ``bits[row, symbol, language]``."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts, key=lambda s: s.encode("utf-8", "surrogatepass"))
        if not self.langs:
            return
        grams = {k: np.stack([(counts[k][0] >> s) & 255 for s in (24, 16, 8, 0)], axis=1) for k in self.langs}
        seen = np.zeros(256, bool)
        for g in grams.values():
            seen[g] = True
        seen[list(_PAD)] = True
        #: symbol 0 stands for every byte that no tree has seen; they all cost the same
        self.symbol = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
        self.size = s = int(seen.sum()) + 1
        unseen = 256 - (s - 1)
        sym = {k: self.symbol[g] for k, g in grams.items()}
        span = [s**k for k in range(ORDER + 1)]
        code = {k: [(x[:, ORDER - o : ORDER] @ np.array(span[:o][::-1], np.int64)) if o else np.zeros(len(x), np.int64) for o in range(ORDER + 1)] for k, x in sym.items()}
        table, self.row = [], np.zeros(1, np.int32)
        at = start = 0
        share = np.ones(s)
        share[0] = unseen  # bytes behind symbol 0
        before = {k: np.tile(share / 256, (1, 1)) for k in self.langs}
        for o in range(ORDER + 1):
            contexts = np.unique(np.concatenate([code[k][o] for k in self.langs]))
            if o:
                # a longer context that nobody has seen uses the row of its last o - 1 bytes
                row = np.tile(self.row, s)
                parents = self.row[contexts % span[o - 1]] - start
                base = {k: before[k][parents] for k in self.langs}
            else:
                row, base = np.zeros(1, np.int32), before
            start = at
            row[contexts] = at + np.arange(len(contexts), dtype=np.int32)
            now = {}
            for k in self.langs:
                c = np.zeros((len(contexts), s))
                np.add.at(c, (np.searchsorted(contexts, code[k][o]), sym[k][:, ORDER]), counts[k][1])
                total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                low = base[k]
                rest = (low * (c == 0)).sum(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escaped = np.where(rest > 0, low * kinds / (total + kinds) / rest, 0)
                    p = np.where(c > 0, c / (total + kinds), escaped)
                now[k] = np.where(total > 0, p, low)
            before = now
            per_byte = share[None, :, None]
            table.append((-np.log2(np.maximum(np.stack([now[k] for k in self.langs], axis=2) / np.where(per_byte > 0, per_byte, 1), 1e-30))).astype(np.float32))
            at += len(contexts)
            self.row = row
        self.bits = np.concatenate(table).reshape(-1, len(self.langs))

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not held:
                return
            s = self.symbol[np.frombuffer(b"".join(x for _, x in held), np.uint8)]
            row = self.row[(s[:-3] * self.size + s[1:-2]) * self.size + s[2:-1]]
            bits = self.bits[row * np.int64(self.size) + s[3:]]
            total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(bits, axis=0, dtype=np.float64)])
            end = np.cumsum([len(x) for _, x in held])
            begin = np.concatenate([[0], end[:-1]])
            np.add.at(out, [k for k, _ in held], total[end - 3] - total[begin])
            held.clear()
            size = 0

        for k, t in enumerate(texts):
            if t:
                b = _PAD + t.encode("utf-8", "surrogatepass")
                for i in range(0, len(b) - ORDER, _PIECE):
                    held.append((k, b[i : i + _PIECE + ORDER]))
                    size += len(held[-1][1])
                    if size >= _PIECE:
                        flush()
        flush()
        return out


def identify(docs: DataFrame, learn: DataFrame, texts: int = TEXTS) -> DataFrame:
    """docs (doc_id, text) with lang_pred and score.

    learn: lang, text and pick (a hash); for each lang the ``texts`` rows of the
    lowest pick fit its tree. A null text or one without a letter gets ``und``
    and score 0, and so does every text where nothing can be learned. Ties go
    to the lang that sorts first. score: the lang's share when all learned
    langs are equally likely beforehand.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = learn.where("lang is not null and text is not null and text <> ''")
    count = usable.groupBy("lang").count().collect()
    share = F.create_map(*[x for r in count for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.2 * texts + 50) / r["count"])))]) if count else None
    trees = Trees({})
    if count:
        u = F.pmod(F.col("pick"), F.lit(1 << 30)) / float(1 << 30)
        drawn = usable.where(u <= share[F.col("lang")])
        rank = F.row_number().over(_by("lang", "pick"))
        trees = Trees(_counts(drawn.withColumn("rank", rank).where(F.col("rank") <= texts).select("lang", "text")))
    shared = spark.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            text, letter = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            text = [x if ok else None for x, ok in zip(text, letter, strict=True)]
            if t.langs:
                bits = t.code_lengths(text)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            pred = [t.langs[best[k]] if x and t.langs else "und" for k, x in enumerate(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array([float(share[k]) if x and t.langs else 0.0 for k, x in enumerate(text)], pa.float64())], names=["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", "text", letter).mapInArrow(score, "doc_id long, lang_pred string, score double")


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order, "text")
