"""Tables that are kept: written once as Parquet in the shared folder, read by every later query."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a session on one machine gets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.noema.ownSharedDir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="store-")
        spark.conf.set("spark.noema.ownSharedDir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def state(spark: SparkSession, paths: list[str]) -> str:
    """A name for what lies at the paths now: every file with its bytes and time of change."""
    seen = []
    for path in paths:
        p, fs = _path(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen.append((path, len(seen)))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written under a name that follows from its sources' state; a later call, of any session that shares the folder, reads it.

    It is written beside and gets its name when it is whole. Of two sessions that
    make it at once the first one's stays.
    """
    path = f"{folder(spark)}/noema-{name}-{state(spark, sources)}"
    if not exists(spark, path):
        beside = f"{path}-{uuid.uuid4().hex}"
        make().write.parquet(beside)
        (old, fs), (new, _) = _path(spark, beside), _path(spark, path)
        if fs.exists(new) or not fs.rename(old, new) or fs.exists(_path(spark, f"{path}/{old.getName()}")[0]):
            # another session was first; a rename onto a folder may have put ours inside it
            fs.delete(old, True)
            fs.delete(_path(spark, f"{path}/{old.getName()}")[0], True)
    return spark.read.parquet(path)


class Table:
    """A table with a key that is loaded, saved, changed and emptied, as an index, a registry or a set of categories is.

    Each save writes a new version beside the old one and only then makes it the
    current one, so a job that fails, or one that still reads the old version,
    is not harmed. The versions before the last are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def versions(self) -> list[int]:
        p, fs = _path(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}"))

    def load(self) -> DataFrame:
        """The rows of the current version; none before the first save."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}")

    def save(self, rows: DataFrame) -> DataFrame:
        found = self.versions()
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(columns).write.mode("overwrite").parquet(f"{self.path}/v{(found or [0])[-1] + 1}")
        for old in found[:-1]:
            remove(self.spark, f"{self.path}/v{old}")
        return self.load()

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Rows of known keys are replaced, others added; the rows given have unique keys."""
        return self.save(self.load().join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def delete(self, keys: DataFrame) -> DataFrame:
        return self.save(self.load().join(keys, self.key, "left_anti"))

    def clear(self) -> int:
        """Empties the table and says how many rows it had."""
        n = self.load().count()
        self.save(self.spark.createDataFrame([], self.schema))
        return n


def relational(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database, filters and columns pushed down; with ``column``, a whole-number key, read in ``parts`` ranges of it at once."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column:
        low, high = reader.option("query", f'SELECT min("{column}") AS low, max("{column}") AS high FROM {table}').load().first()
        if low is not None:
            reader = spark.read.format("jdbc").option("url", url).options(**options).option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.option("dbtable", table).load()


def portable(sql: str) -> str:
    """A statement of the one embedded dialect in that of a server: numbered places for values, the clock, and keys that count on."""
    return sql.replace("?", "%s").replace("datetime('now')", "NOW()").replace("INTEGER PRIMARY KEY AUTOINCREMENT", "SERIAL PRIMARY KEY").replace("AUTOINCREMENT", "SERIAL")


def described(df: DataFrame, rows: int = 100) -> tuple[str, list]:
    """What a table is like: a line with its rows and columns and their types, and its first rows."""
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return f"{df.count()} rows, {len(df.columns)} columns: {kinds}", df.limit(rows).collect()


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """df written and read again, so that what follows doesn't plan all that came before; ``old``, cut before and read no more, is deleted."""
    path = f"{folder(df.sparkSession)}/noema-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    drop(old)
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes what ``cut`` wrote."""
    if df is not None and getattr(df, "_cut_path", None):
        remove(df.sparkSession, df._cut_path)


def delete_batch(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, ...) without the asked ids, and for each asked id whether it counts as deleted (``outcome``) and was there (``known``). An unknown id counts as deleted; a null one fails."""
    left = rows.join(asked.where("id is not null").select("id").distinct(), "id", "left_anti")
    there = rows.select("id").distinct().withColumn("known", F.lit(True))
    told = asked.join(there, "id", "left").withColumn("outcome", F.when(F.col("id").isNull(), "failed").otherwise("deleted"))
    return left, told.withColumn("known", F.coalesce("known", F.lit(False)))
