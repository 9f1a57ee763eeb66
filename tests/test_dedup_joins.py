"""Nearest triples and normalised names against every pair of them in plain Python."""

import random
import re

from noema.operators import dedup

TEXTS = "the cat is part of a house|founded by|n12part of r1|Acme; Ltd|x|, :|AAAA|abcdefghij|abcdefghik|jihgfedcba|".split("|")


def simple(t):
    return re.sub(r"[，,。；;：:\s]+", "", t.lower())[:200]


def best_of(fact, triples, least):
    got = None
    for k, t in triples:
        a, b = simple(fact or ""), simple(t or "")
        if not a or not b:
            continue
        score = round(len(set(a) & set(b)) / max(len(a), len(b)), 9)
        if score > least and (got is None or (score, -k) > got):
            got = score, -k
    return got and (-got[1], got[0], got[0] >= 0.85)


def data(n, m):
    r = random.Random(3)
    word = lambda: "".join(r.sample("abcdefghijklmnopqrstuvwxyz0123456789", r.randrange(3, 14)))
    base = [word() for _ in range(30)]
    near = lambda: "".join(c if r.random() < 0.85 else r.choice("xyz 0,") for c in r.choice(base))
    facts = [(i, near()) for i in range(n)] + [(n + i, base[0].upper()) for i in range(n // 2)]
    facts += [(9000 + i, t) for i, t in enumerate(TEXTS)] + [(9100, None), (9101, "long text " * 500)]
    triples = [(i, near()) for i in range(m)] + [(m + i, t) for i, t in enumerate(TEXTS)] + [(8000, None), (8001, base[0]), (8002, base[0])]
    return facts, triples


def test_nearest_triple_is_that_of_all_pairs(spark):
    facts, triples = data(150, 120)
    f, t = spark.createDataFrame(facts, "id long, fact string"), spark.createDataFrame(triples, "k long, triple string")
    for least in (0.6, 0.75, 0.3):
        want = {i: w for i, x in facts if (w := best_of(x, triples, least))}
        got = {r.id: (r.k, r.score, r.merged) for r in dedup.nearest_triple(f, t, least).collect()}
        assert got == want and 0 < len(want) < len(facts)
    # most pairs are never looked at, none twice
    pairs = dedup.triple_candidates(f, t, 0.6)
    distinct = len({(simple(x or "")) for _, x in facts}) * len({simple(x or "") for _, x in triples})
    assert pairs.count() == pairs.distinct().count() < distinct / 3


def test_nearest_triple_of_nothing(spark):
    f, t = spark.createDataFrame([(1, "abc")], "id long, fact string"), spark.createDataFrame([], "k long, triple string")
    assert dedup.nearest_triple(f, t).count() == 0
    assert dedup.nearest_triple(f.where("false"), t).count() == 0


def plain(name, known, force):
    if name is None:
        return "unique", None
    low = name.lower()
    similar = [(c or n, a or []) for n, c, a in known if (n is not None and low[:30] in n.lower()) or low[:30] in (a or []) or low == ""]
    firsts = [c for c, _ in similar if c is not None]
    same = [c for c, a in similar if c is not None and (c.lower() == low or low in [x.lower() for x in a])]
    best = min(same, default=None) or (min(firsts, default=None) if force else None)
    if best is not None and best != name:
        return "merged", best
    return ("similar_found" if firsts else "unique"), None


def test_normalised_names_are_those_of_all_pairs(spark):
    known = [("Acme Limited", "Acme", ["acme ltd", "ACME Inc"]), ("acme", None, None), ("Berg & Co", "Berg", []), ("Bergwerk", "Bergwerk", ["bw"]), ("b" * 40, None, ["bee"]), (None, "Nobody", ["nil"]), ("日本銀行", None, ["boj"]), ("Acme Limited", "Acme", ["acme ltd"])]
    names = ["Acme", "acme", "ACME LTD", "acme inc", "berg", "BERG", "Bergwerk", "bw", "BW", "limited", "e", "b" * 35, "b" * 41, "nil", "Nobody", "日本", "boj", "unknown", "", None, "l"]
    rows = [(i, n) for i, n in enumerate(names * 3)]
    a, b = spark.createDataFrame(rows, "id long, name string"), spark.createDataFrame(known, "name string, canonical string, aliases array<string>")
    for force in (False, True):
        got = {r.id: (r.status, r.canonical) for r in dedup.normalised(a, b, force).collect()}
        assert got == {i: plain(n, known, force) for i, n in rows}
    assert {r.status for r in dedup.normalised(a, b.where("false")).collect()} == {"unique"}
