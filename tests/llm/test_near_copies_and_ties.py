"""Near copies, ties and shared ids, where an operator could do less than the whole job."""

from collections import defaultdict

from llm.mixing import mix
from llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


def test_near_copies_never_share_a_bin(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:59], f"edit{k}"]), f"s{k % 7}") for k in range(6)]
    rows += [(10 + k, " ".join(f"own{k}x{j}" for j in range(60)), f"s{k % 7}") for k in range(6)]
    rows += [(None, " ".join(base), "s8"), (None, " ".join(base), "s9"), (10, rows[0][1], "s9"), (None, " ".join(base).upper(), "s7")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    alike = {r.cluster for r in got if r.doc_id is None or r.doc_id < 6}
    assert len(alike) == 1 and len({r.cluster for r in got}) == 7
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r.cluster)
    assert all(len(set(b)) == len(b) for b in bins.values())


def test_ties_of_the_last_draw_are_taken_one_by_one(spark):
    rows = [(None, f"word {k}", "s0") for k in range(400)] + [(7, f"term {k}", "s1") for k in range(300)] + [(k, "a b c d", "s2") for k in range(200)]
    docs = documents(spark, rows)
    for carry in ((), ("lang", "n_chars")):
        got = mix(docs, share=0.5, carry=carry).collect()
        assert len(got) == len(rows)
        for s in ("s0", "s1", "s2"):
            mine = [r for r in got if r.source == s]
            assert {r.taken for r in mine} == {0, mine[0]["size"]}
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= mine[0]["size"]
