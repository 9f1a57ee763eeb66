"""What once went wrong: years before our era, deep trees, broken files, long lanes, labels of many centroids."""

from pyspark.sql import functions as F

from noema.functions import moments
from noema.operators import categories, retrieval, timeline
from noema.sources import ingest

TIMES = [
    (1, "始于2024年3月,2023年Q2与2022年见", [("year", "2022年", 2022, None), ("quarter", "2023年Q2", 2023, 4), ("year_month", "2024年3月", 2024, 3)]),
    (2, "于2024-05-06和2023.1.2", [("date", "2023年1月2日", 2023, 1), ("date", "2024年5月6日", 2024, 5)]),
    (3, "2024年春季,公元前 221 年,19世纪 60年代,20世纪", [("era", "公元前 221 年", -221, None), ("era", "19世纪 60年代", 1860, None), ("era", "20世纪", 1900, None), ("year", "2024年", 2024, None), ("season", "2024年春季", 2024, 3)]),
    (4, "2024年13月, 2024-13-40, 0999年", [("year", "2024年", 2024, None)]),
    (5, "no time", []),
    (6, "2024年3月2024年", [("year", "2024年", 2024, None), ("year_month", "2024年3月", 2024, 3)]),
    (7, None, []),
]


def test_time_expressions(spark):
    given = spark.createDataFrame([x[:2] for x in TIMES], "id int, text string").select("id", moments.event_times(F.col("text")).alias("e"))
    got = {r.id: [(e.kind, e.label, e.year, e.month) for e in r.e or []] for r in given.collect()}
    assert got == {i: e for i, _, e in TIMES}


def test_spans_stand_where_the_matches_do(spark):
    texts = ["", "ab12c345", "7", "x7", "7x", "1 2 3", "ü9ü10"]
    import re

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", moments.spans(F.col("t"), "[0-9]+").alias("s"))
    for r in df.collect():
        assert [tuple(x) for x in r.s] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r.t)]


def test_timeline_before_our_era(spark):
    months = spark.createDataFrame([(-221, None), (-221, 1), (2024, 3), (None, None)], "year int, month int")
    got = [tuple(r) for r in timeline.of_months(months).orderBy("place").collect()]
    assert got == [(2024, 3, "2024年3月", 1, 1), (-221, 1, "公元前221年1月", 2, 2)]
    keys = spark.createDataFrame([("x-y",), ("2024-3",), (None,)], "k string")
    assert [r[0] for r in keys.select(moments.label(F.col("k"), "month")).collect()] == ["x-y", "2024年3月", None]


def test_focus_of_a_deep_chain_and_of_a_cycle(spark):
    chain = [(str(k), str(k - 1) if k else None, "x" if k == 13 else "") for k in range(14)] + [("a", "b", "x"), ("b", "a", "")]
    got = categories.focused(spark.createDataFrame(chain, "id string, parent string, name string"), F.col("name") == "x")
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in chain)


def test_every_row_of_a_lane_has_its_rank(spark):
    lane = spark.range(1500).select("id", (-F.col("id")).cast("double").alias("score"))
    got = {r.id: r.rrf for r in retrieval.fuse([lane], 1500).collect()}
    assert len(got) == 1500 and abs(got[1499] - 1 / 1560) < 1e-12


def test_a_label_keeps_its_type_among_many_centroids(spark, monkeypatch):
    monkeypatch.setattr(categories, "SMALL", 1)
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    centroids = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.05]), (9, [0.0, -1.0])], "label long, c array<double>")
    got = categories.near_best(points, centroids, 0.1)
    assert dict(got.dtypes)["label"] == "bigint" and {(r.id, r.label) for r in got.collect()} == {(1, 7), (1, 8), (2, 7), (2, 8)}


def test_a_broken_file_is_taken_as_text():
    for name, kind in (("a.docx", "word"), ("a.pptx", "ppt"), ("a.xlsx", "table"), ("a.ipynb", "notebook")):
        assert ingest.parsed(name, kind, b"no such file") == [("other", "no such file", 0.3)]


def test_chunks_cover_each_text(spark):
    texts = {1: "x" * 100, 2: "".join(chr(97 + k % 26) for k in range(1234)), 3: "", 4: None, 5: "é" * 500, 6: "y" * 501}
    rows = retrieval.chunked(spark.createDataFrame(list(texts.items()), "id long, text string")).orderBy("id", "start").collect()
    by = {}
    for r in rows:
        assert texts[r.id][r.start : r.start + 500] == r.chunk
        by.setdefault(r.id, []).append((r.start, r.start + len(r.chunk)))
    assert {k: v[-1][1] for k, v in by.items()} == {k: len(t) for k, t in texts.items() if t}
    assert all(a[1] - b[0] == 100 for v in by.values() for a, b in zip(v, v[1:], strict=False)) and len(by[5]) == 1 and len(by[6]) == 2


def test_references_of_pages_that_are_cut_off():
    from noema.sources.parsers import page_text

    html = "<title>a &quot;b &amp;c&amp</title><p>x &quot;y&copy; &lt &middot;&amp;</p>"
    assert page_text(html, known={"copy": "©", "middot": "·", "quot": '"'}) == '页面标题: a &quot;b &c&amp\n\na "b &c&amp\nx "y© &lt ·&'
    assert page_text(html) == '页面标题: a "b &c&\n\na "b &c&\nx "y© < ·&'


def test_a_hash_vector_takes_one_hash_of_its_text(spark):
    from noema.functions import scores

    plan = spark.createDataFrame([("x",)], "t string").select(scores.hash_vector(F.col("t"), 64))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("sha2(t") == 1
