"""A search index that grows and shrinks: segments of postings, tombstones, merge on read, compaction by size.

Facts that arrive become a segment of their own; facts that go are named in a list
of tombstones. Neither touches what was written before. A manifest lists
segments and tombstones with their counts, so the number of facts and their
mean length are known without reading any; each change writes the next
manifest, which fails if another writer was first. A reader merges the segments'
postings of its terms and leaves out what later tombstones name. Segments of
like size are merged into one once there are ``FAN`` of them.

A segment is one table, written in one pass over the texts: the postings (id, term,
tf, length) sorted by term, and a row without a term for each fact's length.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators import retrieval
from noema.sources import store

FAN = 4
#: Parts over which a term's postings are dealt, so that a common word isn't one task.
SPREAD = 16
#: Tombstones that are still sent to all tasks; their ids and numbers are some 40 MB. With more of them the postings are shuffled.
TOMBSTONES = 1_000_000


class Index:
    """The index under ``path``; see the module. Ids are whole numbers, each of one fact; a fact added again replaces the old one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # the manifest

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first change."""
        p, fs = store._path(self.spark, self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"segments": [], "tombstones": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{n}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict, after: int) -> None:
        p, fs = store._path(self.spark, f"{self.path}/manifest-{after + 1}.json")
        out = fs.create(p, False)  # an error if another writer has made it
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def fork(self, path: str) -> Index:
        """An index under another path that begins with this one's segments and goes its own way."""
        other = Index(self.spark, path)
        other._publish(self.manifest(), other.version())
        return other

    # reading

    def _rows(self, manifest: dict, which: Column) -> DataFrame:
        """Rows of the live facts, with their segment's number."""
        empty = self.spark.createDataFrame([], "id long, term string, tf long, length int, seg int")
        found = [self.spark.read.parquet(s["path"]).where(which).withColumn("seg", F.lit(s["seq"])) for s in manifest["segments"]]
        rows = reduce(DataFrame.unionByName, found, empty)
        oldest = min((s["seq"] for s in manifest["segments"]), default=0)
        gone = [self.spark.read.parquet(t["path"]).withColumn("until", F.lit(t["seq"])) for t in manifest["tombstones"] if t["seq"] > oldest]
        if not gone:
            return rows
        named = reduce(DataFrame.unionByName, gone).groupBy(F.col("id").alias("gone")).agg(F.max("until").alias("until"))
        if sum(t["ids"] for t in manifest["tombstones"]) <= TOMBSTONES:
            named = F.broadcast(named)
        return rows.join(named, (F.col("id") == F.col("gone")) & (F.col("until") > F.col("seg")), "left_anti")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """id, term, tf, length of the live facts; with ``terms``, of those only, by which the scans are filtered."""
        which = F.col("term").isNotNull() if terms is None else F.col("term").isin(terms)
        return self._rows(self.manifest(), which).drop("seg")

    def lengths(self) -> DataFrame:
        return self._rows(self.manifest(), F.col("term").isNull()).select("id", "length")

    def totals(self) -> tuple[int, float]:
        """Number of live facts and their mean length, from the manifest alone."""
        segments = self.manifest()["segments"]
        n = sum(s["live"] for s in segments)
        return n, sum(s["live_tokens"] for s in segments) / max(n, 1)

    def search(self, query: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """The k best facts by BM25, as ``retrieval.bm25`` gives them."""
        n, mean = self.totals()
        asked = self.spark.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, times int")
        total = self.spark.createDataFrame([(n, float(mean))], "total long, avg_len double")
        return retrieval._scored(self.postings(list(dict.fromkeys(query))), asked, total, k, k1, b)

    # changing

    def _write(self, rows: DataFrame, seq: int) -> dict:
        """A segment of rows (id, term, tf, length), with what the manifest says of it."""
        path = f"{self.path}/segment-{seq}"
        spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
        rows.select("id", "term", "tf", "length").repartition(F.col("term"), spread).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens")).first()
        return {"seq": seq, "path": path, "facts": n.n, "live": n.n, "live_tokens": n.tokens}

    def _bury(self, manifest: dict, ids: DataFrame, seq: int) -> dict:
        """The manifest with those of the ids (id) that are live named in tombstones."""
        live = self._rows(manifest, F.col("term").isNull())
        path = f"{self.path}/tombstones-{seq}"
        live.join(ids.select("id").distinct(), "id", "left_semi").select("id", "length", "seg").write.mode("overwrite").parquet(path)
        # one row for each segment
        lost = {r.seg: r for r in self.spark.read.parquet(path).groupBy("seg").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()}
        if not lost:
            return manifest
        segments = [s | ({"live": s["live"] - lost[s["seq"]].n, "live_tokens": s["live_tokens"] - lost[s["seq"]].tokens} if s["seq"] in lost else {}) for s in manifest["segments"]]
        return {"segments": segments, "tombstones": [*manifest["tombstones"], {"seq": seq, "path": path, "ids": sum(r.n for r in lost.values())}]}

    def add(self, facts: DataFrame) -> None:
        """Facts (id, text) become a segment; null texts have no terms. Only these texts are read."""
        before = self.version()
        manifest = self.manifest(before)
        rows = retrieval.postings(facts.select("id", F.coalesce("text", F.lit("")).alias("text")), "text", whole=True)
        if not facts.groupBy("id").count().where("count > 1").isEmpty():  # rows of one id and length are one fact
            rows = rows.groupBy("id", "length", "term").agg(F.sum("tf").alias("tf"))
        new = self._write(rows, before + 1)
        if manifest["segments"]:
            manifest = self._bury(manifest, self.spark.read.parquet(new["path"]).where("term is null"), before + 1)
        self._publish({"segments": [*manifest["segments"], new], "tombstones": manifest["tombstones"]}, before)
        self.compact()

    def remove(self, ids: DataFrame) -> None:
        """Facts of the ids (id) go; unknown ids are passed over. No text and no posting is read."""
        before = self.version()
        self._publish(self._bury(self.manifest(before), ids, before + 1), before)

    def compact(self, fan: int = FAN) -> bool:
        """Merges the segments of the lowest tier (powers of ``fan`` facts) that has ``fan`` or more, leaving out what is gone."""
        before = self.version()
        manifest = self.manifest(before)
        tiers: dict[int, list[dict]] = {}
        for s in manifest["segments"]:
            tiers.setdefault(int(math.log(max(s["live"], 1), fan)), []).append(s)
        full = next((tiers[k] for k in sorted(tiers) if len(tiers[k]) >= fan), None)
        if full is None:
            return False
        names = {s["seq"] for s in full}
        merged = self._write(self._rows({"segments": full, "tombstones": manifest["tombstones"]}, F.lit(True)), before + 1)
        kept = [s for s in manifest["segments"] if s["seq"] not in names]
        oldest = min([s["seq"] for s in kept], default=before + 1)
        # tombstones speak of segments before them only
        self._publish({"segments": [*kept, merged], "tombstones": [t for t in manifest["tombstones"] if t["seq"] > oldest]}, before)
        return True


def of_documents(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents' texts, built once for each state of the table."""
    from noema.sources.tables import read

    index = Index(spark, f"{store.folder(spark)}/noema-index-{store.state(spark, [f'{sf_dir}/documents.parquet'])}")
    if not index.version():
        index.add(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return index
