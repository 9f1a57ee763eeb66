"""Stored tables, files, communities, pictures and the model hook, where no SQL can check them."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noema.functions import model
from noema.operators import categories, communities, graph, images
from noema.sources import code, ingest, parsers, store


def test_a_stored_table_keeps_its_versions_apart(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", ["id"], "id bigint, name string")
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, name string")
    assert t.load().count() == 0
    t.save(rows((1, "a"), (2, "b")))
    before = t.load()
    t.upsert(rows((2, "c"), (3, "d")))
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (2, "b")]  # a reader of the old version isn't harmed
    assert sorted(map(tuple, t.load().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    t.delete(rows((1, "x")).select("id"))
    assert sorted(map(tuple, t.load().collect())) == [(2, "c"), (3, "d")]
    assert len(t.versions()) == 2 and t.clear() == 2 and t.load().count() == 0


def test_kept_tables_follow_their_sources(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.range(3).write.parquet(source)
    read = lambda: store.kept(spark, "test", [source], lambda: spark.read.parquet(source)).count()
    assert read() == 3 == store.kept(spark, "test", [source], lambda: 1 / 0).count()
    spark.range(5).write.mode("overwrite").parquet(source)
    assert read() == 5


def test_relational_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).write.format("jdbc").option("url", url).option("dbtable", "things").save()
    got = store.relational(spark, url, "things", "id", 4)
    assert got.count() == 100 and got.rdd.getNumPartitions() == 4
    assert store.relational(spark, url, "things").where("id = 7").first()[1] == "n7"
    assert store.portable("INSERT INTO t VALUES (?, datetime('now'))") == "INSERT INTO t VALUES (%s, NOW())"
    assert store.portable("id INTEGER PRIMARY KEY AUTOINCREMENT") == "id SERIAL PRIMARY KEY"


def test_described_tables(spark):
    line, head = store.described(spark.range(300), 100)
    assert line == "300 rows, 1 columns: id bigint" and len(head) == 100


def test_louvain_comes_near_the_planted_division(spark):
    r = np.random.default_rng(1)
    size, rows = 12, []
    for a in range(5 * size):
        for b in range(a + 1, 5 * size):
            if r.random() < (0.6 if a // size == b // size else 0.03):
                rows.append((f"n{a:02}", f"n{b:02}", "R", 1.0))
    edges = spark.createDataFrame(rows, "src string, dst string, rel string, conf double")
    links = communities.weighted(edges)
    found = communities.louvain(edges, levels=2, rounds=6)
    planted = links.select(F.col("src").alias("node"), F.floor(F.substring("src", 2, 2).cast("int") / size).cast("string").alias("c")).distinct()
    spread = graph.label_propagation(edges, 5)
    score = lambda df, c: communities.modularity(links, df.select("node", F.col(c).alias("c")))
    assert score(found, "community") > communities.modularity(links, planted) - 0.03 and score(found, "community") > score(spread, "label") - 0.03
    assert communities.louvain(edges.limit(0)).count() == 0


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures_of_the_image_source(spark, tmp_path):
    r = np.random.default_rng(0)
    white, noise, page = np.full((20, 30, 3), 250, np.uint8), r.integers(0, 256, (20, 30, 3)).astype(np.uint8), np.full((40, 20, 3), 240, np.uint8)
    page[:3] = 10  # three dark lines of forty
    for name, x in (("white", white), ("noise", noise), ("page", page)):
        png(tmp_path / f"{name}.png", x)
    i = F.col("image")
    s = images.statistics(i["data"], i["width"], i["height"], i["nChannels"])
    got = {r.o.rpartition("/")[2]: r for r in spark.read.format("image").load(str(tmp_path)).select(i["origin"].alias("o"), s.alias("s")).select("o", "s", images.category(F.col("s")).alias("c"), images.visual_type(F.col("s")).alias("v")).collect()}
    assert abs(got["noise.png"].s.brightness - noise.mean()) < 1e-9 and got["white.png"].s.max_0 == 250
    assert (got["white.png"].c, got["page.png"].c, got["noise.png"].c) == ("photo", "document", "text_dense")
    assert (got["white.png"].v, got["page.png"].v) == ("low_contrast", "mixed")


def test_a_model_that_fails_leaves_the_rule(spark):
    df = spark.createDataFrame([(k, f"t{k}" if k != 3 else None) for k in range(10)], "id long, text string").repartition(1)

    def call(texts):
        if "t8" in texts:
            raise RuntimeError("no service")
        return [f"m:{t}" if t else None for t in texts]

    got = {r.id: (r.a, r.a_by) for r in model.answered(df, "text", "a", F.lit("rule"), call, batch=1).collect()}
    assert got[1] == ("m:t1", "model") and got[8] == ("rule", "rule") and got[3] == ("rule", "rule")
    assert {r.a_by for r in model.answered(df, "text", "a", F.upper("text")).collect()} == {"rule"}
    assert [model.calibrated(F.lit(0.5), p) is not None for p in (None, [(0.1, 0.0), (0.9, 1.0)])] == [True, True]


def test_clusters_of_unlike_points_are_apart(spark):
    rows = [(k, [1.0, 0.01 * k, 0.0] if k % 2 else [0.0, 0.01 * k, 1.0]) for k in range(20)]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.cluster for r in categories.kmeans(points, 10).collect()}
    assert len({got[k] for k in range(0, 20, 2)}) == len({got[k] for k in range(1, 20, 2)}) == 1 and got[0] != got[1]
    assert {r.cluster for r in categories.kmeans(points.limit(5), 10).collect()} == {-1}


def test_many_centroids_meet_points_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    cents = spark.createDataFrame([("a", [1.0, 0.05]), ("b", [0.05, 1.0])], "label string, c array<double>")
    want = sorted(map(tuple, categories.near_best(points, cents, 0.1).collect()))
    monkeypatch.setattr(categories, "SMALL", 0)
    assert sorted(map(tuple, categories.near_best(points, cents, 0.1).collect())) == want and len(want) == 2


def test_a_tree_that_is_too_deep_is_an_error(spark):
    nodes = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(6)], "id string, parent string")
    assert categories.tree(nodes, 6).count() == 6
    with pytest.raises(Exception, match="more than 3 levels"):
        categories.tree(nodes, 3).collect()


def test_open_tags_end_with_what_holds_them():
    html = "<body><div><header>gone<p>gone too</div><p>Kept line</p><br>And this</body>"
    assert parsers.page_text(html) == "Kept line\nAnd this"


def test_code_that_does_not_parse(spark):
    assert code.python_edges("a.py", "def f(:") == [] and code.chunks("a.py", "def f(:") == [("code", "def f(:")]
    assert ingest.parsed("x/a.docx", "word", b"no archive") == [("other", "no archive", 0.3)]  # as any file that its parser can't read
    assert ingest.parsed("x/a.csv", "table", b"") == [("other", "", 0.3)]


def test_paths_meet_in_the_middle(spark):
    import itertools

    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("d", "a")]
    e = spark.createDataFrame([(x, y, "R", 0.5 + k / 10, str(k)) for k, (x, y) in enumerate(rows)], "src string, dst string, rel string, conf double, eid string")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "conf", "eid"))
    want = set()
    for n in range(1, 5):
        for use in itertools.permutations(range(len(rows)), n):
            at, route = "a", ["a"]
            for k in use:
                if at not in rows[k]:
                    break
                at = rows[k][1] if at == rows[k][0] else rows[k][0]
                route.append(at)
            else:
                if at == "d":
                    want.add((n, round(sum(0.5 + k / 10 for k in use) / n + 1e-9, 3), ">".join(route)))
    got = graph.paths(both, "a", "d", 4, 1000).collect()
    assert {tuple(r) for r in got} == want and len(got) >= len(want)
