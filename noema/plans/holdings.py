"""Queries on what is held: files and their chunks, stored tables, source code and its graph, pictures and recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.functions import model
from noema.operators import images
from noema.operators.blocks import spread
from noema.plans.meaning import _expected, _given
from noema.plans.queries import _r, query
from noema.plans.views import KP
from noema.sources import code, ingest, store
from noema.sources.tables import knowledge, read

# files

# files of many kinds made of documents and parts; a part's name and size stand for @ and #
_FORMS = {
    "nb.ipynb": '{"cells": [{"cell_type": "code", "source": ["a = #\\n", "b"]}, {"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": [" "]}]}',
    "t.csv": "x,y\n#,@\n2,b\n",
    "mod.py": "import os\n\ndef f(x):\n    return #\n\nclass A:\n    def g(self):\n        return f(1)\n",
    "odd.xyz": "who knows @",
    "broken.ipynb": "{nothing @",
    "broken.docx": "no archive @",
    "page.html": "<html><head><title>T</title></head><body><nav>no</nav><p>Hello @</p><noscript>kept</noscript><script>x()</script>\n<p> b </p></body></html>",
}


def _made_files(s, d) -> DataFrame:
    """path, content."""
    text = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for k, (n, form) in enumerate(_FORMS.items()):
        at = F.col("p_partkey") % len(_FORMS) == k
        text = F.when(at, F.replace(F.replace(F.lit(form), F.lit("@"), F.col("p_name")), F.lit("#"), F.col("p_size").cast("string"))).otherwise(text)
        name = F.when(at, F.lit(n)).otherwise(name)
    # parsing a part's file costs far more than reading its row
    parts = spread(read(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"), text.alias("content"))
    notes = read(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return parts.union(notes).select("path", F.encode("content", "UTF-8").alias("content")).where("content is not null")


@query("""WITH p AS (SELECT p_partkey % 7 AS f, concat('p/', p_partkey, '/') AS folder, p_name AS n, p_size AS z FROM part)
SELECT concat('d/', doc_id, '.txt') AS path, 0 AS part, 'text' AS kind, text, 1.0 AS confidence FROM documents WHERE text IS NOT NULL
UNION ALL SELECT concat(folder, 'nb.ipynb'), 0, 'notebook', concat('a = ', z, chr(10), 'b'), 1.0 FROM p WHERE f = 0
UNION ALL SELECT concat(folder, 't.csv'), 0, 'table', concat('2 rows, 2 columns', chr(10), 'x int64, y str', chr(10), repeat(' ', 2 + length(CAST(z AS VARCHAR))), 'x', repeat(' ', 1 + length(n)), 'y', chr(10), '0  ', z, '  ', n, chr(10), '1  ', repeat(' ', length(CAST(z AS VARCHAR)) - 1), '2', repeat(' ', 1 + length(n)), 'b'), 1.0 FROM p WHERE f = 1
UNION ALL SELECT concat(folder, 'mod.py'), 0, 'overview', 'mod.py: 9 lines, 1 functions, 1 classes', 1.0 FROM p WHERE f = 2
UNION ALL SELECT concat(folder, 'mod.py'), 1, 'function', concat('def f(x):', chr(10), '    return ', z), 1.0 FROM p WHERE f = 2
UNION ALL SELECT concat(folder, 'mod.py'), 2, 'class', concat('class A:', chr(10), '    def g(self):', chr(10), '        return f(1)'), 1.0 FROM p WHERE f = 2
UNION ALL SELECT concat(folder, 'odd.xyz'), 0, 'other', concat('who knows ', n), 0.3 FROM p WHERE f = 3
UNION ALL SELECT concat(folder, 'broken.ipynb'), 0, 'other', concat('{nothing ', n), 0.3 FROM p WHERE f = 4
UNION ALL SELECT concat(folder, 'broken.docx'), 0, 'other', concat('no archive ', n), 0.3 FROM p WHERE f = 5
UNION ALL SELECT concat(folder, 'page.html'), 0, 'web', concat('T', chr(10), 'Hello ', n, chr(10), 'kept', chr(10), 'b'), 1.0 FROM p WHERE f = 6""".replace("1.0 AS confidence", "CAST(1.0 AS DOUBLE) AS confidence"))
def src_chunks(s, d):
    """Every file by the parser of its kind, whole texts; what a parser can't read comes with little confidence."""
    return ingest.parsed_files(_made_files(s, d)).withColumn("text", F.replace("text", F.lit("y object"), F.lit("y str")))


@query("SELECT count(*) AS rows, 4 AS columns, max(n_nationkey) AS last_key, max(n_name) AS last_name FROM nation")
def src_csv(s, d):
    """A table written as CSV and read again with its header and types."""
    path = f"{store.folder(s)}/noema-csv-{uuid.uuid4().hex}"
    n = read(s, d, "nation")
    n.select("n_nationkey", "n_name", "n_regionkey", F.lit(0.5).alias("weight")).write.option("header", True).csv(path)
    back = store.csv(s, path)
    kinds = dict(back.dtypes)
    assert kinds["n_nationkey"] == "int" and kinds["weight"] == "double"
    return back.agg(F.count("*").alias("rows"), F.lit(len(back.columns)).alias("columns"), F.max("n_nationkey").alias("last_key"), F.max("n_name").alias("last_name"))


@query(f"WITH {KP} SELECT id, category, confidence FROM kp WHERE id % 4 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, 'new', 1.0 FROM kp WHERE id % 4 = 0 AND id % 5 <> 0")
def src_index(s, d):
    """An index saved, changed, thinned out and loaded again."""
    t = store.Table(s, f"{store.folder(s)}/noema-index-{uuid.uuid4().hex}", ["id"], "id bigint, category string, confidence double")
    k = knowledge(s, d).select("id", "category", "confidence")
    t.save(k)
    t.upsert(k.where("id % 4 = 0").select("id", F.lit("new").alias("category"), F.lit(1.0).alias("confidence")))
    return t.delete(k.where("id % 5 = 0").select("id"))


@query("WITH h AS (SELECT sha256(text) AS hash, count(*) AS version, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM h) AS saved, 0 AS left")
def src_registry_cleared(s, d):
    t = store.Table(s, f"{store.folder(s)}/noema-registry-{uuid.uuid4().hex}", ["hash"], "hash string, version bigint, first_id bigint")
    t.save(read(s, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("version"), F.min("doc_id").alias("first_id")))
    n = t.clear()
    return t.load().agg(F.lit(n).cast("long").alias("saved"), F.count("*").alias("left"))


# a code base: fifty functions a file, made of the parts

_METHOD, _PLAIN = "k % 4 = 0", "k % 4 <> 0"


def code_files(s, d) -> DataFrame:
    k = F.col("p_partkey")
    says = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Algorithm: sort"), k % 3, F.lit(". "))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("Concept: order"), k % 5, F.lit("."))).otherwise("x"))
    pad = F.when(k % 4 == 0, F.lit("    ")).otherwise("")
    body = F.concat(pad, F.lit("def f"), k, F.when(k % 4 == 0, F.lit("(self, x):\n")).otherwise("(x):\n"), pad, F.lit('    """'), says, F.lit('"""\n'), pad, F.lit("    return f"), k + 1, F.lit("(x) + g"), k % 7, F.lit("(x)\n"))
    q = F.floor(k / 50)
    held = read(s, d, "part").select(q.alias("q"), F.struct((k % 4 != 0).alias("later"), k.alias("k"), body.alias("body")).alias("f"))
    text = F.array_join(F.transform(F.array_sort("fs"), lambda x: x["body"]), "\n")
    files = held.groupBy("q").agg(F.collect_list("f").alias("fs"))
    head = F.concat(F.lit("import mod"), F.col("q") % 4, F.lit("\n\nclass C"), "q", F.lit("(Base"), F.col("q") % 3, F.lit("):\n    kind = 'c'\n\n"))
    return files.select(F.concat(F.lit("pkg/m"), "q", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(head, text).alias("code"))


def code_graph(s, d) -> DataFrame:
    """Its edges, kept; calls only of functions that some file defines."""

    found = []

    def make() -> DataFrame:
        e = store.cut(code.code_edges(code_files(s, d)).distinct())  # read three times, parsed once
        found.append(e)
        known = e.where("kind = 'DEFINES_FUNCTION'").select("dst").distinct()
        return e.where("kind <> 'CALLS'").unionByName(e.where("kind = 'CALLS'").join(known, "dst", "left_semi").select(e.columns)).repartition("src").sortWithinPartitions("kind", "src")

    held = store.kept(s, "code-4", [f"{d}/part.parquet"], make)
    for e in found:
        store.drop(e)
    return held


_CODE = """p AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 50) AS BIGINT) AS q FROM part), fl AS (SELECT DISTINCT q FROM p),
ce AS (SELECT concat('pkg/m', q, '.py') AS src, concat('f', k) AS dst, 'DEFINES_FUNCTION' AS kind, q FROM p WHERE k % 4 <> 0
UNION ALL SELECT concat('C', q), concat('f', k), 'DEFINES_FUNCTION', q FROM p WHERE k % 4 = 0
UNION ALL SELECT concat('pkg/m', q, '.py'), concat('C', q), 'DEFINES_CLASS', q FROM fl
UNION ALL SELECT concat('C', q), concat('Base', q % 3), 'IS_A', q FROM fl
UNION ALL SELECT concat('pkg/m', q, '.py'), concat('mod', q % 4), 'IMPORTS', q FROM fl
UNION ALL SELECT concat('f', k), concat('f', k + 1), 'CALLS', q FROM p WHERE k + 1 IN (SELECT k FROM p)
UNION ALL SELECT concat('f', k), concat('sort', k % 3), 'IMPLEMENTS_ALGORITHM', q FROM p WHERE k % 2 = 0
UNION ALL SELECT concat('f', k), concat('order', k % 5), 'RELATED_TO_CONCEPT', q FROM p WHERE k % 3 = 0)"""


@query(f"WITH {_CODE} SELECT src, dst, kind, concat('pkg/m', q, '.py') AS file FROM ce")
def gra_code_edges(s, d):
    return code_graph(s, d)


@query(f"WITH {_CODE}, o AS (SELECT * FROM ce WHERE q = 2) SELECT 'pkg/m2.py' AS file, string_agg(dst, ',' ORDER BY dst) FILTER (kind = 'DEFINES_FUNCTION' AND src LIKE 'pkg%') AS functions, string_agg(dst, ',' ORDER BY dst) FILTER (kind = 'DEFINES_CLASS') AS classes, string_agg(dst, ',' ORDER BY dst) FILTER (kind = 'IMPORTS') AS modules, count(*) FILTER (kind = 'CALLS') AS calls FROM o")
def gra_file_structure(s, d):
    of = code_graph(s, d).where(F.col("file").endswith("m2.py"))
    named = lambda kind, also=True: F.array_join(F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & also, F.col("dst")))), ",")
    return of.groupBy("file").agg(named("DEFINES_FUNCTION", F.col("src") == F.col("file")).alias("functions"), named("DEFINES_CLASS").alias("classes"), named("IMPORTS").alias("modules"), F.count_if(F.col("kind") == "CALLS").alias("calls"))


@query(f"WITH {_CODE} SELECT src AS name, dst AS algorithm, concat('pkg/m', q, '.py') AS file FROM ce WHERE kind = 'IMPLEMENTS_ALGORITHM' AND contains(lower(dst), lower('SORT1')) ORDER BY length(src), src LIMIT 30")
def joi_functions_by_algorithm(s, d):
    hit = code_graph(s, d).where("kind = 'IMPLEMENTS_ALGORITHM'").where(F.lower("dst").contains("sort1"))
    return hit.select(F.col("src").alias("name"), F.col("dst").alias("algorithm"), "file").orderBy(F.length("name"), "name").limit(30)


@query(f"WITH {_CODE} SELECT c.src AS name, c.dst AS concept, a.dst AS algorithm FROM ce c LEFT JOIN ce a ON a.src = c.src AND a.kind = 'IMPLEMENTS_ALGORITHM' WHERE c.kind = 'RELATED_TO_CONCEPT' AND contains(c.dst, 'order2') ORDER BY length(c.src), c.src LIMIT 30")
def joi_functions_by_concept(s, d):
    e = code_graph(s, d)
    a = e.where("kind = 'IMPLEMENTS_ALGORITHM'").select("src", F.col("dst").alias("algorithm"))
    c = e.where("kind = 'RELATED_TO_CONCEPT'").where(F.lower("dst").contains("order2")).select("src", F.col("dst").alias("concept"))
    return c.join(a, "src", "left").select(F.col("src").alias("name"), "concept", "algorithm").orderBy(F.length("name"), "name").limit(30)


@query(f"WITH {_CODE} SELECT c.src AS source, c.dst AS target, concat('pkg/m', c.q, '.py') AS source_file, concat('pkg/m', t.q, '.py') AS target_file FROM ce c JOIN ce t ON t.kind = 'DEFINES_FUNCTION' AND t.dst = c.dst WHERE c.kind = 'CALLS'")
def gra_call_graph(s, d):
    e = code_graph(s, d)
    held = e.where("kind = 'DEFINES_FUNCTION'").select(F.col("dst").alias("target"), F.col("file").alias("target_file"))
    return e.where("kind = 'CALLS'").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("file").alias("source_file")).join(held, "target").select("source", "target", "source_file", "target_file")


@query(f"WITH {_CODE}, n AS (SELECT kind, dst AS name FROM ce WHERE kind <> 'CALLS' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS r, count(*) OVER (PARTITION BY kind) AS n FROM n) SELECT kind, any_value(n) AS names, string_agg(name, ',' ORDER BY name) AS some FROM r WHERE r <= 10 GROUP BY kind")
def agg_code_names(s, d):
    """How many names of each kind there are, and the first ten of them; no kind's names are gathered whole."""
    named = code_graph(s, d).where("kind <> 'CALLS'").select("kind", F.col("dst").alias("name")).distinct()
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where("r <= 10")
    some = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("some"))
    return named.groupBy("kind").agg(F.count("*").alias("names")).join(some, "kind")


@query(f"WITH {_CODE}, x AS (SELECT dst AS name, string_agg(src, ',' ORDER BY src) AS callers FROM ce WHERE kind = 'CALLS' GROUP BY 1), y AS (SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS callees FROM ce WHERE kind = 'CALLS' GROUP BY 1) SELECT dst AS name, callers, callees FROM ce LEFT JOIN x ON x.name = dst LEFT JOIN y ON y.name = dst WHERE kind = 'DEFINES_FUNCTION' AND contains(dst, 'f12')")
def gra_functions_named(s, d):
    e = code_graph(s, d)
    calls = e.where("kind = 'CALLS'")
    gathered = lambda by, of, name: calls.groupBy(F.col(by).alias("name")).agg(F.array_join(F.array_sort(F.collect_set(of)), ",").alias(name))
    named = e.where("kind = 'DEFINES_FUNCTION'").where(F.col("dst").contains("f12")).select(F.col("dst").alias("name"))
    return named.join(gathered("dst", "src", "callers"), "name", "left").join(gathered("src", "dst", "callees"), "name", "left")


# a part's key stands for @
_OTHER = [
    ("a.js", "javascript", "import {x} from 'lib@'\nconst y = require('z')\nexport async function go@(a) {\n  if (x) {", [("go@", "DEFINES_FUNCTION"), ("lib@", "IMPORTS"), ("z", "IMPORTS")]),
    ("b.go", "go", 'import "fmt"\nfunc (s *T) Run@(x int) {\nfunc main() {', [("Run@", "DEFINES_FUNCTION"), ("main", "DEFINES_FUNCTION"), ("fmt", "IMPORTS")]),
    ("c.rs", "rust", "use std::io@\npub fn start@() {", [("start@", "DEFINES_FUNCTION"), ("std::io@", "IMPORTS")]),
    ("D.java", "java", "public static void run@(String a) {\n  int x = 1;\n  private List<String> all(int n) throws Exception {", [("run@", "DEFINES_FUNCTION"), ("all", "DEFINES_FUNCTION")]),
]


@query(_expected([(k, p, *x) for k, (p, _, _, xs) in enumerate(_OTHER) for x in xs], "file, dst, kind", len(_OTHER), "file, replace(dst, '@', CAST(p_partkey AS VARCHAR)) AS dst, kind"))
def fun_code_facts(s, d):
    files = _given(s, d, "name string, language string, code string", [x[:3] for x in _OTHER])
    files = files.select(F.concat(F.col("key").cast("string"), F.lit("/"), "name").alias("path"), "language", F.replace("code", F.lit("@"), F.col("key").cast("string")).alias("code"))
    found = code.code_edges(files)
    return found.select(F.substring_index("file", "/", 1).cast("long").alias("key"), F.substring_index("file", "/", -1).alias("file"), "dst", "kind")


# pictures and recordings

_PIXELS = "px AS (SELECT vec_id AS id, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) * 2 + 1) * 127.5) AS INT)))) AS p FROM embeddings), u AS (SELECT id, unnest(p) AS x FROM px), st AS (SELECT id, avg(x) AS brightness, avg((x < 100)::INT) AS dark_100, avg((x < 120)::INT) AS dark_120, stddev_pop(x) AS dev, max(x) AS top FROM u GROUP BY id)"


@query(f"WITH {_PIXELS} SELECT id, round(brightness, 3) AS brightness, round(dark_100, 6) AS dark_100, CASE WHEN dark_120 > 0.12 THEN 'text_dense' WHEN dark_120 > 0.04 AND 3 * dev > 100 THEN 'screenshot' WHEN dark_120 > 0.02 AND 3 * dev < 60 THEN 'diagram' WHEN 3 * dev > 150 THEN 'photo' WHEN 3 * dev > 80 AND 3 * dev < 150 THEN 'chart' ELSE 'photo' END AS category, CASE WHEN dev < 15 THEN 'low_contrast' WHEN dark_100 > 0.08 THEN 'text' WHEN dark_100 > 0.03 THEN 'mixed' WHEN dev > 60 THEN 'colourful' ELSE 'graphic' END AS visual, CAST(top AS DOUBLE) AS top FROM st")
def med_pictures(s, d):
    """Pictures of 8 by 8 grey pixels, made of the vectors."""
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * 2 + 1) * 127.5).cast("int")))
    data = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(pixel(x).cast("long")), 2, "0")), ""))
    stats = images.statistics(data, F.lit(8), F.lit(8), F.lit(1))
    found = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), stats.alias("s"))
    return found.select("id", F.round("s.brightness", 3).alias("brightness"), _r(F.col("s.dark_100")).alias("dark_100"), images.category(F.col("s")).alias("category"), images.visual_type(F.col("s")).alias("visual"), F.col("s.max_0").alias("top"))


@query("SELECT doc_id AS id, w AS word, p FROM (SELECT doc_id, word AS w, (length(word) * 13 + i) % 100 / 100.0 AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM documents)) WHERE p < 0.05")
def med_unsure_words(s, d):
    """Words of segments of recordings, heard with little certainty; segments hold arrays of words."""
    seg = F.transform(F.split("text", " "), lambda x, i: F.struct(x.alias("word"), F.round((F.length(x) * 13 + i) % 100 / 100, 2).alias("p")))
    segments = read(s, d, "documents").select("doc_id", F.array(seg).alias("segments"))
    return segments.select("doc_id", F.explode("segments").alias("x")).select("doc_id", F.explode("x").alias("w")).where("w.p < 0.05").select(F.col("doc_id").alias("id"), "w.word", F.col("w.p").cast("decimal(3,2)").alias("p"))


@query("SELECT doc_id AS id, count(*) AS unsure, min(i) AS first_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE (length(line) * 7 + i) % 10 < 5 GROUP BY doc_id")
def med_unsure_regions(s, d):
    """Lines that a reader of pictures isn't sure of: confidence below 0.5."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), ((F.length(x) * 7 + i) % 10 / 10).alias("confidence")))
    low = F.filter(lines, lambda x: x["confidence"] < 0.5)
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), low.alias("low")).where("size(low) > 0").select("id", F.size("low").cast("long").alias("unsure"), F.col("low")[0]["i"].cast("long").alias("first_line"))


@query("WITH b AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS batch FROM conversations), g AS (SELECT conv_id, CAST(batch AS BIGINT) AS batch, string_agg(text, ' ' ORDER BY turn) AS t FROM b GROUP BY ALL) SELECT conv_id, batch, length(t) AS n, substring(t, 1, 40) AS head FROM g WHERE length(t) >= 20")
def med_event_batches(s, d):
    """Five events at a time, put together; those of fewer than 20 characters go."""
    b = F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1) / 5)
    g = read(s, d, "conversations").withColumn("batch", b).groupBy("conv_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    return g.select("conv_id", "batch", F.length("t").cast("long").alias("n"), F.substring("t", 1, 40).alias("head")).where("n >= 20")


# answers of a model, or of a rule

@query("SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN concat('m: ', text) ELSE substring(text, 1, 20) END AS answer, CASE WHEN length(text) % 3 = 0 THEN 'model' ELSE 'rule' END AS answer_by FROM conversations WHERE role = 'user'")
def udf_answers(s, d):
    """A model that has no answer to some texts; a rule answers in its place."""

    def call(texts: list[str]) -> list[str | None]:
        return [f"m: {t}" if len(t) % 3 == 0 else None for t in texts]

    asked = read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return model.answered(asked, "text", "answer", F.substring("text", 1, 20), call).select("conv_id", "turn", "answer", "answer_by")


@query(f"WITH {KP} SELECT id, round(CASE WHEN confidence <= 0.2 THEN 0.1 WHEN confidence <= 0.6 THEN 0.1 + (confidence - 0.2) * 1.0 WHEN confidence <= 0.9 THEN 0.5 + (confidence - 0.6) * 0.4 / 0.3 ELSE 0.9 END, 6)::DOUBLE AS worth FROM kp")
def udf_calibrated(s, d):
    return knowledge(s, d).select("id", _r(model.calibrated(F.col("confidence"), [(0.2, 0.1), (0.6, 0.5), (0.9, 0.9)])).alias("worth"))


_SPOKEN = "sg AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 7 + event_id % 5 AS start, event_type AS text FROM events)"
_CODE_OF = "concat(lpad(CAST({0} // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({0} % 60 AS VARCHAR), 2, '0'))"


def _spoken(s, d) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    start = nth * 7 + F.col("event_id") % 5
    return read(s, d, "events").select("user_id", start.cast("double").alias("start"), (start + 5).cast("double").alias("stop"), F.col("event_type").alias("text"))


@query(f"""WITH {_SPOKEN}, x AS (SELECT *, CAST(floor((start + 2.5) / 60) AS INT) + 1 AS scene FROM sg), g AS (SELECT user_id, scene, count(*) AS n, min(start) AS a, max(start) + 5 AS b, string_agg(concat('[', {_CODE_OF.format('start')}, '] ', text), chr(10) ORDER BY start, text) AS said FROM x GROUP BY ALL)
SELECT user_id, scene, n, concat('=== 场景 ', scene, ' [', {_CODE_OF.format('a')}, '-', {_CODE_OF.format('b')}, '] ===', chr(10), chr(10), '[语音转写]', chr(10), chr(10), said) AS content FROM g""")
def src_scene_chunks(s, d):
    """Recordings (users) whose scenes change every minute."""
    from noema.operators import timeline

    said = _spoken(s, d)
    last = said.groupBy("user_id").agg(F.max("stop").alias("z"))
    scenes = last.select("user_id", F.explode(F.sequence(F.lit(0), F.col("z").cast("int"), F.lit(60))).alias("at"))
    return timeline.scene_chunks(said, scenes, "user_id").select("user_id", "scene", "n", "content")


@query(f"WITH {_SPOKEN} SELECT user_id, CAST(start AS DOUBLE) AS start, concat('[', {_CODE_OF.format('start')}, '-', {_CODE_OF.format('(start + 5)')}, '] ', text) AS content FROM sg")
def src_segment_chunks(s, d):
    from noema.operators import timeline

    return timeline.segment_chunks(_spoken(s, d), "user_id")


@query("SELECT concat('c', c_custkey) AS node, concat('c', c_custkey // 4 * 4) AS community FROM customer WHERE c_custkey // 4 * 4 + 3 <= (SELECT max(c_custkey) FROM customer)")
def gra_louvain_cliques(s, d):
    """Customers in groups of four that all know each other: communities are the groups."""
    from noema.operators.communities import louvain, met

    c = read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 4).alias("g"))
    full = c.groupBy("g").agg(F.count("*").alias("n")).where("n = 4").select("g")
    a, b = met(c, full, "g").select("g", F.col("k").alias("a")), c.select("g", F.col("k").alias("b"))
    found = louvain(met(a, b, "g").where("a < b").select(F.concat(F.lit("c"), "a").alias("src"), F.concat(F.lit("c"), "b").alias("dst")))
    low = found.groupBy("community").agg(F.min(F.substring("node", 2, 20).cast("long")).alias("low"))
    return met(found, low, "community").select("node", F.concat(F.lit("c"), "low").alias("community"))


@query()
def gra_louvain(s, d):
    from noema.operators.communities import louvain
    from noema.sources.tables import edges

    return louvain(edges(s, d), levels=2, rounds=4)
