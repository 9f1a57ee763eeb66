"""What large tables need: costly rows of few bytes go to all tasks, and what is read often is parsed once."""

import numpy as np
from pyspark.sql import functions as F

from noema.operators import code_graph, communities, cosine_join, retrieval, segments
from noema.plans import holdings
from noema.sources import code, parsers


def _tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_of_few_bytes_are_parsed_by_all_tasks(spark):
    files = spark.range(0, 400, 1, 1).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("def f"), "id", F.lit("(x):\n    return g(x)\n")).alias("code"))
    assert _tasks(parsers.code_functions(files)) > 1
    found = code.code_edges(files)
    assert _tasks(found) > 1
    assert found.count() == 800 and found.where("kind = 'CALLS' and dst = 'g'").count() == 400


def test_functions_are_parsed_once_for_all_edges(spark):
    files = spark.createDataFrame([("a.py", "def a():\n    b()\n    c()\n"), ("b.py", "def b():\n    a()\n")], "path string, code string")
    edges = code_graph.code_edges(parsers.code_functions(files))
    assert "MapInPandas" not in edges._jdf.queryExecution().toString()
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "CALLS"), ("a.py", "a", "CONTAINS"), ("b", "a", "CALLS"), ("b.py", "b", "CONTAINS")]


def test_files_made_of_a_small_table_are_parsed_by_all_tasks(spark):
    made = holdings._made_files(spark, "/root/testdata/sf0.01").where("path like 'p/%'")
    assert _tasks(made) > 1


def test_a_text_is_counted_without_a_shuffle(spark):
    texts = [(1, "B b a 中中 c"), (2, ""), (3, None), (4, "one"), (5, "a-a-a")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = retrieval.postings(docs, "text", whole=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 1, 7), (1, "b", 2, 7), (1, "c", 1, 7), (1, "中", 2, 7), (1, "中中", 1, 7), (4, "one", 1, 1), (5, "a", 3, 3)}
    rows = [tuple(r) for r in got.collect()]
    assert {r for r in rows if r[1]} == {w for w in want if w[1]} and len(rows) == len(set(rows))
    assert {(r[0], r[3]) for r in rows if r[1] is None} >= {(1, 7), (2, 0), (4, 1), (5, 3)}


def test_rows_of_one_fact_are_counted_together(spark, tmp_path):
    index = segments.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, "b"), (3, None)], "id long, text string"))
    assert sorted(map(tuple, index.postings().collect())) == [(1, "a", 4, 3), (1, "b", 2, 3), (2, "b", 1, 1)]
    assert sorted(map(tuple, index.lengths().collect())) == [(1, 3), (2, 1), (3, 0)]


def test_a_fifth_of_many_facts_goes_without_shuffling_postings(spark, tmp_path):
    index = segments.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.range(120_000).select("id", F.concat(F.lit("w"), F.col("id") % 10).alias("text")))
    index.remove(spark.range(0, 120_000, 5).select("id"))
    left = index.postings()
    assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 96_000 and index.totals() == (96_000, 1.0)


def test_vectors_without_structure_go_to_few_tasks(spark):
    x = np.random.default_rng(5).normal(size=(3000, 32))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    plan = cosine_join.Plan(rows.where("id % 20 = 0"), rows, 0.3)
    assert plan.share == 1 and len(plan.pivots) > 10
    # two blocks of the others, one of the asked, however many cells there are
    assert [(g[2], g[3]) for g in plan.groups] == [(1, 2)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(unit[::20] @ unit.T, 4)
    want = {(int(i) * 20, int(j)) for i, j in zip(*np.nonzero(sim >= 0.3), strict=True) if i * 20 != j}
    got = [(r.a, r.b) for r in plan.pairs().collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_table_of_a_graph_is_broadcast(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("c", "d")], "src string, dst string")
    found = communities.louvain(e)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    division = spark.createDataFrame([(x, x) for x in "abcde"], "node string, c string")
    links = communities.weighted(e)
    moved = communities._moved(links, division, links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), 10.0, 0)
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()
