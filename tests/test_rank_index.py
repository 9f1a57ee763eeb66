"""The kept list against sorting the whole."""

import random
import uuid

import pytest

from noema.operators.rank_index import RankIndex, sorted_by
from noema.sources import store


@pytest.fixture(scope="module")
def held(spark):
    r = random.Random(2)
    rows = [(f"2024-0{r.randrange(1, 7)}-{r.randrange(1, 29):02d}", k * 3, r.choice("ab")) for k in range(1234)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "day string, id long, kind string").selectExpr("cast(day as date) as day", "id", "kind").repartition(6)
    path = f"{store.folder(spark)}/list-{uuid.uuid4().hex}"
    index = RankIndex(spark, path, [("day", True), ("id", False)], "day date, id long, kind string").build(df, most=100)
    return index, sorted(sorted(rows, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)


def found(df):
    return [(str(r.day), r.id, r.kind) for r in df.collect()]


def test_files_stand_in_order(held):
    index, rows = held
    files = index.files()
    assert len(files) >= 12 and max(f["rows"] for f in files) <= 100 and sum(f["rows"] for f in files) == len(rows) and sorted_by(files, index)


def test_pages(held):
    index, rows = held
    for number in (1, 2, 5, 13, 30, 61, 62, 63, 500):
        page = index.page(number, 20)
        assert found(page) == rows[(number - 1) * 20 : number * 20]
        assert len(page.inputFiles()) <= 2  # whichever page it is


def test_cursors_both_ways(held):
    index, rows = held
    for at in (0, 1, 57, 99, 100, 101, 600, 1232, 1233):
        key = [rows[at][0], rows[at][1]]
        assert found(index.after(key, 25)) == rows[at + 1 : at + 26]
        assert found(index.before(key, 25)) == rows[max(0, at - 25) : at][::-1]
        assert len(index.after(key, 25).inputFiles()) <= 2
    assert found(index.after(["2024-03-05", -1], 7)) == [x for x in rows if (x[0] == "2024-03-05" and x[1] > -1) or x[0] < "2024-03-05"][:7]
    assert found(index.after(["1999-01-01", 0], 5)) == [] and found(index.before(["2999-01-01", 0], 5)) == []


def test_an_empty_list(spark):
    index = RankIndex(spark, f"{store.folder(spark)}/list-{uuid.uuid4().hex}", [("id", False)], "id long").build(spark.createDataFrame([], "id long"))
    assert index.files() == [] and index.page(1, 5).count() == index.after([3], 5).count() == index.before([3], 5).count() == 0
