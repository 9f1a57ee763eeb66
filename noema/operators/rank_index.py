"""A list kept in its order: pages open the files that hold them, cursors find theirs by bounds.

The rows are written once, sorted, in files of a bounded number of rows. A manifest
says how many rows each file has and between which keys they lie, so a page far
down costs what the first one costs, and no request sorts or counts the list.
"""

from __future__ import annotations

import json
from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.sources import store

ROWS = 20_000
#: Manifests that this process has read; what lies under a path never changes.
_read: dict[str, list[dict]] = {}


class RankIndex:
    """A list under ``path`` in the order of ``keys``, pairs of a column and whether it falls; no key is null, and all together are unique."""

    def __init__(self, spark: SparkSession, path: str, keys: list[tuple[str, bool]], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema

    def order(self, turned: bool = False) -> list[Column]:
        return [F.col(k).desc() if falls != turned else F.col(k).asc() for k, falls in self.keys]

    def exists(self) -> bool:
        return self.path in _read or store.exists(self.spark, f"{self.path}/manifest")

    def build(self, rows: DataFrame, most: int = ROWS) -> RankIndex:
        """Writes the list; rows has the keys and the other columns of the schema."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(names).orderBy(*self.order()).write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{self.path}/rows")
        key = F.to_json(F.array(*[F.col(k).cast("string") for k, _ in self.keys]))
        at = F.struct(*[F.col(k) for k, _ in self.keys])
        held = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(F.input_file_name().alias("file"), at.alias("at"), key.alias("key"), F.monotonically_increasing_id().alias("n"))
        # within a file rows keep their order
        files = held.groupBy("file").agg(F.count("*").alias("rows"), F.min_by("key", "n").alias("first"), F.max_by("key", "n").alias("last"))
        files.orderBy("file").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")
        return self

    def files(self) -> list[dict]:
        """The files in order: rows, first and last keys, and the rows before each."""
        if self.path not in _read:
            kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
            typed = lambda text: [float(x) if kinds[k] == "double" else int(x) if kinds[k] in ("bigint", "int") else x for (k, _), x in zip(self.keys, json.loads(text), strict=True)]
            found = sorted((r.asDict() for r in self.spark.read.schema("file string, rows long, first string, last string").json(f"{self.path}/manifest").collect()), key=lambda r: (len(r["file"]), r["file"]))
            before = 0
            for r in found:
                r |= {"first": typed(r["first"]), "last": typed(r["last"]), "before": before}
                before += r["rows"]
            _read[self.path] = found
        return _read[self.path]

    def _compare(self, a: list, b: list) -> int:
        """Below 0 where key a stands before key b."""
        for (_, falls), x, y in zip(self.keys, a, b, strict=True):
            if x != y:
                return -1 if (x > y) == falls else 1
        return 0

    def _open(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f["file"] for f in files])

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` from 1; none beyond the last."""
        start = (number - 1) * size
        held = [f for f in self.files() if f["before"] < start + size and f["before"] + f["rows"] > start]
        rows = self._open(held).orderBy(*self.order())
        return rows.offset(start - held[0]["before"]).limit(size) if held else rows

    def _beyond(self, key: list, forward: bool) -> Column:
        """Rows behind (or before) a key in the order."""
        tests, equal = [], F.lit(True)
        for (k, falls), x in zip(self.keys, key, strict=True):
            tests.append(equal & (F.col(k) < F.lit(x) if falls == forward else F.col(k) > F.lit(x)))
            equal = equal & (F.col(k) == F.lit(x))
        return reduce(lambda a, b: a | b, tests)

    def after(self, key: list, size: int) -> DataFrame:
        """The ``size`` rows behind a key, in order."""
        held = [f for f in self.files() if self._compare(f["last"], key) > 0]
        return self._open(self._enough(held, size)).where(self._beyond(key, True)).orderBy(*self.order()).limit(size)

    def before(self, key: list, size: int) -> DataFrame:
        """The ``size`` rows before a key, the nearest first."""
        held = [f for f in self.files() if self._compare(f["first"], key) < 0][::-1]
        return self._open(self._enough(held, size)).where(self._beyond(key, False)).orderBy(*self.order(turned=True)).limit(size)

    @staticmethod
    def _enough(files: list[dict], size: int) -> list[dict]:
        """The first file, part of which counts, and as many more as hold ``size`` rows."""
        held, rows = files[:1], 0
        for f in files[1:]:
            if rows >= size:
                break
            held.append(f)
            rows += f["rows"]
        return held


def sorted_by(files: list[dict], keys: RankIndex) -> bool:
    """Whether files stand in the order of their keys."""
    ends = [k for f in files for k in (f["first"], f["last"])]
    return ends == sorted(ends, key=cmp_to_key(keys._compare))
