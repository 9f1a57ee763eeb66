import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, nulls, an empty text, a long one, repeated rows and columns that clash with the operators' own."""
    import random

    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    rows = [(k, text(r.randrange(1, 90)), "en", f"s{k % 3}") for k in range(60)]
    base = text(120)
    for k in range(60, 80):
        w = base.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        rows.append((k, " ".join(w), "en", "s0"))
    rows += [(80 + k, rows[0][1].upper(), None, None) for k in range(5)]
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, " \t\n", "en", "s1"), (93, "one two", "en", "s2"), (94, "one TWO", "en", "s2"), (95, text(30000), "en", "s2"), (95, None, "en", "s2"), (3, rows[3][1], "en", "s0"), (None, "no id at all", "en", "s1"), (96, "x" * 3000000, "en", "s1")]
    data = [(i, t, lang, src, len(t or ""), "c", "c", "c", 0.5, 1) for i, t, lang, src in rows]
    return spark.createDataFrame(data, DOC + ", shard string, size string, component string, log_weight double, lane int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
