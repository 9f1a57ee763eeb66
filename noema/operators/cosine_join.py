"""Vectors of at least a cosine, exactly, without meeting all others: cells around pivots and what the triangle inequality allows.

The angle of two vectors is a distance. A bounded sample of the vectors are pivots;
each vector is in the cell of its nearest one. For each cell and each pivot the
least and the greatest angle of the cell's vectors to the pivot are known. Two
vectors within an angle t differ by no more than t in their angle to any pivot, so
cells whose intervals at some pivot lie farther apart than t have no pair to give
and never meet. Cells that meet the same cells are put together and cut into blocks
of bounded size, so that a row goes to as many tasks as there are blocks to meet,
however many cells these come from. Every pair that may be one is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.functions.scores import norm
from noema.operators.blocks import BLOCK

#: Pivots, at most: their vectors and a table of their number squared go to every task.
PIVOTS = 256
#: Angles that rounding may add.
SLACK = 1e-6


def _unit(m) -> np.ndarray:
    x = np.stack(list(m)).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


class Plan:
    """Which cells of the asked vectors meet which cells of the others, and how many rows that is."""

    def __init__(self, asked: DataFrame, vectors: DataFrame, threshold: float, pivots: int | None = None):
        clean = lambda df: df.where("v is not null").select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where(norm(F.col("v")) > 0)
        self.threshold, self.spark = threshold, vectors.sparkSession
        asked, vectors = clean(asked), clean(vectors)
        n = vectors.count()
        wanted = min(PIVOTS, max(1, -(-n // 256))) if pivots is None else pivots
        # a bounded sample, the same for each run
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        self.pivots = _unit([r.v for r in sample]) if sample else np.zeros((1, 1))
        self.asked, self.vectors = self._placed(asked), self._placed(vectors)
        a, b = self._intervals(self.asked), self._intervals(self.vectors)
        self.rows = {(i, j): (a[i][0], b[j][0]) for i in a for j in b if self._may_meet(a[i], b[j])}
        whole = sum(x[0] for x in a.values()) * sum(x[0] for x in b.values())
        #: Share of all pairs that is computed.
        self.share = sum(x * y for x, y in self.rows.values()) / max(whole, 1)
        self.groups = self._grouped({i: x[0] for i, x in a.items()}, {j: x[0] for j, x in b.items()})

    def _grouped(self, a: dict[int, int], b: dict[int, int]) -> list[tuple]:
        """Cells of the others that meet the same asked cells, put together: their cells, the asked cells, the blocks of the asked and of the others, the first task's number."""
        partners: dict[int, list[int]] = {}
        for i, j in sorted(self.rows):
            partners.setdefault(j, []).append(i)
        alike: dict[tuple, list[int]] = {}
        for j, met in partners.items():
            alike.setdefault(tuple(met), []).append(j)
        out, first = [], 0
        for met, cells in alike.items():
            n_a, n_b = -(-sum(a[i] for i in met) // BLOCK), -(-sum(b[j] for j in cells) // BLOCK)
            out.append((cells, met, n_a, n_b, first))
            first += n_a * n_b
        return out

    def _placed(self, df: DataFrame) -> DataFrame:
        pivots = self.pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(cell=_angles(_unit(b["v"]), pivots).argmin(axis=1).astype(np.int32))

        return df.mapInPandas(place, "id long, v array<double>, cell int")

    def _intervals(self, placed: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        """Rows, least and greatest angles to every pivot of each cell; no more rows than pivots squared."""
        pivots = self.pivots

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    angle = _angles(_unit(b["v"]), pivots)
                    for cell in np.unique(b["cell"]):
                        mine = angle[(b["cell"] == cell).to_numpy()]
                        yield pd.DataFrame({"cell": np.int32(cell), "pivot": np.arange(len(pivots), dtype=np.int32), "low": mine.min(0), "high": mine.max(0), "n": len(mine)})

        found = placed.mapInPandas(summed, "cell int, pivot int, low double, high double, n long").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
        return {int(c): (int(g["n"].iloc[0]), g.sort_values("pivot")["low"].to_numpy(), g.sort_values("pivot")["high"].to_numpy()) for c, g in found.groupby("cell")}

    def _may_meet(self, a: tuple, b: tuple) -> bool:
        reach = np.arccos(np.clip(self.threshold - 1e-4, -1, 1)) + SLACK
        return bool((np.maximum(a[1] - b[2], b[1] - a[2]) <= reach).all())

    def pairs(self) -> DataFrame:
        """a, b, sim (4 places) of the pairs that reach the threshold, no vector with itself."""
        # a task for each block of a group's asked rows and each block of its others
        kind = "cell int, n_a int, n_b int, first long"
        asked = [(i, n_a, n_b, first) for _, met, n_a, n_b, first in self.groups for i in met]
        others = [(j, n_a, n_b, first) for cells, _, n_a, n_b, first in self.groups for j in cells]

        def dealt(df: DataFrame, side: str, to: list[tuple]) -> DataFrame:
            own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            met = df.join(F.broadcast(self.spark.createDataFrame(to, kind)), "cell")
            at = met.select("*", own("n_a").alias("x"), every("n_b").alias("y")) if side == "a" else met.select("*", every("n_a").alias("x"), own("n_b").alias("y"))
            return at.select((F.col("first") + F.col("x") * F.col("n_b") + F.col("y")).alias(f"task_{side}"), "id", "v")

        threshold = self.threshold

        def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            i, j, sim = np.empty(0, int), np.empty(0, int), np.empty((0, 0))
            if len(q) and len(r):
                sim = _unit(q["v"]) @ _unit(r["v"]).T
                i, j = np.nonzero(sim >= threshold - 1e-4)
            return pd.DataFrame({"a": q["id"].to_numpy()[i], "b": r["id"].to_numpy()[j], "sim": sim[i, j] if len(i) else np.empty(0)})

        found = dealt(self.asked, "a", asked).groupBy("task_a").cogroup(dealt(self.vectors, "b", others).groupBy("task_b")).applyInPandas(near, "a long, b long, sim double")
        return found.where("a <> b").select("a", "b", F.round("sim", 4).alias("sim")).where(F.col("sim") >= threshold)
