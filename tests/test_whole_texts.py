"""What lies beyond a text's beginning, a table's first rows or a function's first calls counts too."""

import io

import pandas as pd

from noema.operators import code_graph
from noema.plans import more  # noqa: F401
from noema.plans.queries import QUERIES
from noema.sources import code, ingest, parsers


def test_sources_are_compared_by_whole_texts(spark, tmp_path):
    head = "a" * 60
    docs = [(2, head + "bcdefgh", "x"), (3, head + "bcdefgh", "y"), (24, head + "bcxyz", "y"), (8, head + "uvwxyz", "x"), (41, head, "z"), (None, "b", "z")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    sure = {k: (k * 37) % 101 / 100 for k, _, _ in docs if k}
    want = {}
    for i, a, s in docs:
        for j, b, t in docs:
            if s < t:
                n = want.setdefault((s, t), [0, 0])
                if i and j:
                    sim = len(set(a) & set(b)) / len(set(a) | set(b))
                    n[0] += sim > 0.5 and sure[i] > 0.7 and sure[j] > 0.7
                    n[1] += 0.15 < sim <= 0.4 and abs(sure[i] - sure[j]) > 0.2
    got = {(r.source_a, r.source_b): [r.agreeing, r.conflicting] for r in QUERIES["ctg_source_comparison"](spark, str(tmp_path)).collect()}
    assert got == want and sum(n[1] for n in want.values()) > 0


def test_every_call_and_import_is_an_edge(spark):
    text = "".join(f"import m{k}\n" for k in range(45)) + "def f():\n" + "".join(f"    g{k}()\n" for k in range(35))
    files = spark.createDataFrame([("a.py", "python", text)], "path string, language string, code string")
    found = [tuple(r) for r in code.code_edges(files).collect()]
    assert {r[1] for r in found if r[2] == "IMPORTS"} == {f"m{k}" for k in range(45)}
    assert {r[1] for r in found if r[:1] == ("f",) and r[2] == "CALLS"} == {f"g{k}" for k in range(35)}
    assert len(found) == 45 + 35 + 1


def test_every_called_function_is_in_the_graph_of_files(spark):
    text = "def f():\n" + "".join(f"    g{k}()\n" for k in range(35)) + "    unknown()\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "".join(f"def g{k}():\n    pass\n" for k in range(35)))], "path string, code string")
    functions = parsers.code_functions(files)
    assert [len(r.calls) for r in functions.where("name = 'f'").collect()] == [36]
    found = [tuple(r) for r in code_graph.code_edges(functions).collect()]
    assert {r[1] for r in found if r[::2] == ("f", "CALLS")} == {f"g{k}" for k in range(35)} and len(found) == 36 + 35


def test_every_row_of_a_table_is_in_its_text():
    rows = [(k, f"name{k}" if k != 7 else "wide" * 2000) for k in range(350)]
    for n in (0, 1, 100, 101, 350):
        content = "x,y\n" + "".join(f"{a},{b}\n" for a, b in rows[:n])
        ((kind, text, sure),) = ingest.parsed("p/t.csv", "table", content.encode())
        assert (kind, sure) == ("table", 1.0) and text.startswith(f"{n} rows, 2 columns\n")
        if n <= 100:
            assert text.split("\n", 2)[2] == pd.read_csv(io.BytesIO(content.encode())).to_string()
        if n:
            assert [tuple(x.split()) for x in text.split("\n")[3:]] == [(str(a), str(a), b) for a, b in rows[:n]]
    assert len(text) < 101 * 8100 + 250 * 20
