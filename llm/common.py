"""What the operators share: input tables, cut lineage, frozen arrays."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a session on one machine gets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.llm.ownSharedDir", None)
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.llm.ownSharedDir", named)
    return named


#: What each open ``scratch`` of this thread has to delete, the innermost last.
_scopes = threading.local()


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage and outlives any executor. Rows and schema stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    for scope in _open_scopes()[-1:]:
        scope.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unsettle(df: DataFrame) -> None:
    """Deletes what ``settle`` wrote, once nothing reads it any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what this thread settles inside, failed or not, but for what is given to ``keep``: ``with scratch(spark) as keep: out = keep(settle(df))``.

    What is kept is left to the scope around this one, if there is any.
    """
    mine: list[str] = []
    kept: set[str] = set()
    scopes = _open_scopes()
    scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._settled_path)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for path in mine:
            if path not in kept:
                _delete(spark, path)
            elif scopes:
                scopes[-1].append(path)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of text-reading stages small, so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
