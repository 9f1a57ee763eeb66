"""The segmented index against an index made anew of the facts that are left."""

import random
import uuid

import pytest

from noema.operators import retrieval
from noema.operators.segments import Index
from noema.sources import store

WORDS = "ant bee cat dog elk fox gnu hen".split()


def facts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def same(spark, index, held):
    """The index gives what one made of ``held`` (id -> text) would."""
    anew = facts(spark, [(k, t or "") for k, t in held.items()])
    want = retrieval.bm25(anew, "text", ["ant", "bee", "zzz"], 50).collect()
    got = index.search(["ant", "bee", "zzz"], 50).collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want]
    total = retrieval.corpus_stats(anew, "text").first()
    n, mean = index.totals()
    assert n == total.total_docs and abs(mean - (total.avg_len or 0)) < 1e-9
    assert {r.id for r in index.lengths().collect()} == set(held)


def test_changes_of_many_kinds(spark):
    r = random.Random(3)
    index = Index(spark, f"{store.folder(spark)}/index-{uuid.uuid4().hex}")
    held: dict[int, str | None] = {}
    for step in range(6):
        new = {r.randrange(60): r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 9)))]) for _ in range(12)}
        index.add(facts(spark, list(new.items())))
        held |= new
        gone = [r.randrange(70) for _ in range(5)]
        index.remove(facts(spark, [(k, None) for k in gone]))
        held = {k: v for k, v in held.items() if k not in gone}
        if step % 2:
            same(spark, index, held)
    assert len(index.manifest()["segments"]) < 6  # some were merged
    same(spark, index, held)
    index.remove(facts(spark, [(k, None) for k in held]))
    assert index.totals() == (0, 0.0) and index.search(["ant"], 5).count() == 0


def test_a_change_reads_its_own_texts_only(spark, tmp_path):
    rows = [(k, f"ant number {k}") for k in range(200)]
    facts(spark, rows).write.parquet(str(tmp_path / "facts"))
    index = Index(spark, f"{store.folder(spark)}/index-{uuid.uuid4().hex}")
    index.add(spark.read.parquet(str(tmp_path / "facts")))
    store.remove(spark, str(tmp_path / "facts"))  # nobody can read them now
    index.remove(facts(spark, [(k, None) for k in range(20)]))
    index.add(facts(spark, [(1000 + k, f"ant and bee {k}") for k in range(20)]))
    same(spark, index, {k: t for k, t in rows if k >= 20} | {1000 + k: f"ant and bee {k}" for k in range(20)})
    read = index.postings(["bee"])
    assert read.count() == 20 and not any("tombstones" in f and "segment" in f for f in read.inputFiles())


def test_forks_and_two_writers(spark):
    index = Index(spark, f"{store.folder(spark)}/index-{uuid.uuid4().hex}")
    index.add(facts(spark, [(1, "ant"), (2, "bee")]))
    other = index.fork(f"{index.path}-fork")
    other.remove(facts(spark, [(1, None)]))
    assert (index.totals()[0], other.totals()[0]) == (2, 1)
    same(spark, index, {1: "ant", 2: "bee"})
    same(spark, other, {2: "bee"})
    with pytest.raises(Exception, match="exist"):
        index._publish(index.manifest(), index.version() - 1)
