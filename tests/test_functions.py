"""Formulas and parsers against plain Python."""

import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noema.functions import scores, text
from noema.operators import categories, dedup, graph, listing, retrieval, timeline
from noema.sources import parsers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tokens_of_cjk_and_words(spark):
    df = spark.createDataFrame([("知识 Graph-图 x_1",), ("",), (None,)], "t string").select(text.tokens(F.col("t")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got == [["知", "识", "图", "知识", "graph", "图", "x_1"], [], None]


def test_cosine_and_hash_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(x[0], 9) for x in rows(df.select(scores.cosine(F.col("a"), F.col("b"))))] == [0.0, 1.0]
    v = spark.createDataFrame([("a",)], "t string").select(scores.hash_vector(F.col("t"), 64).alias("v")).first().v
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 and v[32:] == [0.0] * 32


def test_char_jaccard(spark):
    df = spark.createDataFrame([("abc", "bcd"), ("", "")], "a string, b string").select(text.char_jaccard(F.col("a"), F.col("b")))
    assert rows(df) == [(0.5,), (0.0,)]


def test_fold_feedback_is_in_order(spark):
    df = spark.createDataFrame([(["negative", "correct", "positive"],), (["correct"] * 4,)], "e array<string>").select(scores.fold_feedback(F.col("e")).alias("f"))
    assert [tuple(r.f) for r in df.collect()] == [(4.0, 2.5), (6.0, 1.0)]


def test_decay_falls(spark):
    df = spark.createDataFrame([(0,), (10,), (-5,), (None,)], "d int").select(scores.decay(F.col("d")))
    assert [round(x[0], 9) for x in rows(df)] == [1.0, round(math.exp(-0.05), 9), 1.0, 1.0]


def test_fusion_ignores_the_order_of_lanes(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    x, y = rows(retrieval.fuse([a, b], 5)), rows(retrieval.fuse([b, a], 5))
    assert x == y and x[0][0] == 2


def test_pages_partition_the_list(spark):
    df = spark.range(47).select("id", F.lit(0.5).alias("confidence"))
    got = [r.id for n in range(1, 6) for r in listing.page(df, [F.col("id")], n, 10).collect()]
    assert got == list(range(47)) and listing.page(df, [F.col("id")], 999, 10).count() == 0


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "id long, t string")
    once = dedup.first_by_prefix(df, "t")
    assert sorted(rows(once)) == sorted(rows(dedup.first_by_prefix(once, "t"))) == [(1, "aa"), (3, "b")]


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 0.5), ("a", "c", "R", 0.2)], "src string, dst string, rel string, conf double")
    assert rows(graph.paths(e, "a", "c", 3)) == [(1, 0.2, "a>c"), (2, 0.75, "a>b>c")]


def test_capped_segments(spark):
    s = spark.createDataFrame([("k", 0.0, 30.0, "a"), ("k", 31.0, 55.0, "b"), ("k", 56.0, 70.0, "c"), ("k", 80.0, 90.0, "d")], "key string, start double, stop double, text string")
    got = rows(timeline.capped_segments(s, "key", 2.0, 60.0).select("segment", "text").orderBy("segment"))
    assert got == [(0, "a b"), (1, "c"), (2, "d")]


def test_as_of_takes_the_last_boundary(spark):
    p = spark.createDataFrame([("k", 0.5, 1), ("k", 5.0, 2), ("k", 7.0, 3)], "key string, t double, point long")
    b = spark.createDataFrame([("k", 1.0), ("k", 5.0)], "key string, at double")
    assert sorted((r.point, r.bound) for r in timeline.as_of(p, b, "key").collect()) == [(1, 1.0), (2, 5.0), (3, 5.0)]


def test_events_in_texts(spark):
    df = spark.createDataFrame([("2023年5月 and 2021-12, 2021-13",)], "t string").select(timeline.events_in(F.col("t")).alias("e"))
    assert df.first().e == ["2021-12", "2023-05"]


def test_page_text():
    html = "<html><title>T</title><body><nav>menu item</nav><p>Long line</p><p>ab</p><script>var x</script></body></html>"
    assert parsers.page_text(html) == "页面标题: T\n\nLong line" and parsers.page_text(html, 1, False) == "T\nLong line\nab" and parsers.page_text("") is None


def test_python_facts_and_notebooks(spark):
    code = "def f(a, b):\n    if a:\n        return g(b)\n    return 0\n"
    df = parsers.code_functions(spark.createDataFrame([("x.py", code), ("y.py", "def (")], "path string, code string"))
    assert rows(df) == [("x.py", "f", ["a", "b"], ["g"], 2)]
    nb = spark.createDataFrame([('{"cells":[{"cell_type":"code","source":["a=1"]},{"cell_type":"markdown","source":["x"]},{"cell_type":"code","source":[" "]}]}',)], "content string")
    assert parsers.notebook_code(nb).first().code == "a=1"


@given(st.sampled_from(["select 1", "WITH x AS (SELECT 1) SELECT * FROM x", "select 'drop table x'"]))
def test_read_only_accepts_queries(q):
    assert text.read_only(q)


def test_read_only_refuses_writes():
    for q in ("drop table x", "select 1; delete from x", "insert into x select 1", "with x as (select 1) insert into y select * from x", ""):
        assert not text.read_only(q)


def test_stream_equals_batch(spark, tmp_path):
    from noema.sources.tables import read
    from noema.streaming import events

    src = read(spark, "/root/testdata/sf0.001", "events")
    folder = str(tmp_path / "in")
    src.write.parquet(folder)
    out = events.window_counts(events.stream(spark, folder, src.schema), late="0 seconds")
    q = out.writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    batch = events.window_counts(src.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(str, rows(spark.table("wc").select("start", "event_type", "n")))) == sorted(map(str, rows(batch.select("start", "event_type", "n"))))


def test_compare_sources_in_many_blocks(spark, monkeypatch):
    from noema.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 7)
    facts = [(f"s{k % 3}", None if k == 5 else "abcdefghij"[k % 4 : k % 9 + 2] + "xyz"[: k % 3], (k * 37 % 101) / 100) for k in range(60)] + [(None, "abc", 0.9)]
    want = {}
    for a, x, p in facts:
        for b, y, q in facts:
            if a and b and x is not None and y is not None and a < b:
                union = set(x) | set(y)
                sim = len(set(x) & set(y)) / len(union) if union else 0
                n = want.setdefault((a, b), [0, 0])
                n[0] += sim > 0.5 and p > 0.7 and q > 0.7
                n[1] += 0.15 < sim <= 0.4 and abs(p - q) > 0.2
    got = categories.compare_sources(spark.createDataFrame(facts, "source string, fact string, confidence double")).collect()
    assert {(r.source_a, r.source_b): [r.agreeing, r.conflicting] for r in got} == want


def test_similar_pairs_in_many_blocks(spark, monkeypatch):
    import numpy as np

    from noema.operators import blocks, dedup

    monkeypatch.setattr(blocks, "BLOCK", 9)
    v = np.random.default_rng(3).normal(size=(40, 3))
    v[7] = 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b): r.sim for r in dedup.similar_pairs(df.where("id % 4 = 0"), df, 0.8).collect()}
    want = {(a, b): round(float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])), 4) for a in range(0, 40, 4) for b in range(40) if a != b and b != 7}
    assert got == {k: s for k, s in want.items() if s >= 0.8}


def test_capped_segments_split_at_pauses(spark):
    rows_ = [("a", 0.0, 1.0, "x"), ("a", 1.5, 3.0, "y"), ("a", 9.0, 10.0, "z"), ("b", 0.0, 40.0, "p"), ("b", 40.0, 80.0, "q"), (None, 0.0, 1.0, None)]
    got = timeline.capped_segments(spark.createDataFrame(rows_, "key string, start double, stop double, text string"), "key", 2.0, 60.0)
    assert sorted((r.key or "", r.segment, r.text, r.length) for r in got.collect()) == [("", 0, "", 1.0), ("a", 0, "x y", 2.5), ("a", 1, "z", 1.0), ("b", 0, "p", 40.0), ("b", 1, "q", 40.0)]


def test_small_only_broadcasts_what_is_small(spark):
    from noema.operators.blocks import small

    few = spark.range(5)
    assert "broadcast" in small(few)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in small(few, most=4)._jdf.queryExecution().logical().toString()
