"""Equal pairs, conflicts, searches, deletions and questions against plain Python."""

import itertools
import re

from noema.functions import rules, scores
from noema.operators import categories, dedup, retrieval, timeline
from noema.sources import store
from pyspark.sql import functions as F


def test_equal_pairs_are_the_first_of_all(spark):
    rows = [(k, f"fact {k % 4}" if k % 5 else "the same", k % 3) for k in range(400)] + [(None, "the same", 1), (500, None, 1), (501, None, 2)]
    facts = spark.createDataFrame(rows, "id long, fact string, version int")
    got = [tuple(r) for r in dedup.equal_pairs(facts, 30).orderBy("first", "second").collect()]
    named = [r for r in rows if r[0] is not None and r[1] is not None]
    want = sorted((a[0], b[0], a[1], a[2], b[2]) for a, b in itertools.combinations(named, 2) if a[1] == b[1])[:30]
    assert got == want
    assert dedup.equal_pairs(facts.where("false")).count() == 0


def test_conflicts_point_to_the_first_that_began_alike(spark):
    facts = ["The sun, is hot", "the sun", "The sun is hot", "Thesunishot", "x" * 60, "x" * 30 + "y" * 30, "other"]
    hits = spark.createDataFrame(list(enumerate(facts)), "place int, fact string")
    seen, want = {}, []
    for k, f in enumerate(facts):
        start = re.sub(r"[，,。；;：:\s]+", "", f[:30])
        if start in seen:
            want.append((k, f[:50], seen[start][:50]))
        seen.setdefault(start, f)
    assert [tuple(r) for r in retrieval.conflicts(hits).collect()] == want[:3] and len(want) == 3
    assert retrieval.conflicts(hits, 1).count() == 1 and retrieval.conflicts(hits.where("false")).count() == 0


def test_search_of_categories(spark):
    cats = spark.createDataFrame([(3, "Method", None), (1, "Facts", "what HAPPENED"), (2, "None", ""), (4, None, "happened")], "place int, name string, description string")
    assert [r.place for r in categories.search(cats, "Happened").collect()] == [1, 4]
    assert [r.place for r in categories.search(cats, "", 2).collect()] == [1, 2]


def test_batch_of_deletions(spark):
    rows, asked = spark.range(10), spark.createDataFrame([(3,), (3,), (99,), (None,)], "id long")
    left, told = store.delete_batch(rows, asked)
    assert sorted(r.id for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert sorted(map(str, ((r.id, r.outcome, r.known) for r in told.collect()))) == sorted(map(str, [(3, "deleted", True)] * 2 + [(99, "deleted", False), (None, "failed", False)]))


def test_questions_follow_the_segments(spark):
    pairs = spark.createDataFrame([("a", 2, "how?", "so"), ("a", 1, "why?", None), ("b", 1, "who?", "they")], "of string, at int, question string, answer string")
    segments = spark.createDataFrame([("a", 4), ("c", 1)], "of string, chunks long")
    got = {r.of: tuple(r) for r in timeline.qa_chunks(pairs, segments, "of").collect()}
    assert got["a"] == ("a", 4, 2, "=== 问答对提取 ===\nQ: why?\nA: \n\nQ: how?\nA: so\n")
    assert got["b"][1:3] == (0, 1) and len(got) == 2


def test_feedback_and_trust(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    for kind, a, b in (("positive", 3, 2), ("negative", 2, 3), ("correct", 3, 1.5), ("other", 2, 2)):
        up = scores.updated(F.lit(kind), F.lit(2.0), F.lit(2.0))
        assert (one(up[0]), one(up[1])) == (a, b)
        base = 0.4 * 0.9 + 0.3 * 0.5 + 0.3 * 0.7
        base = (base + a / (a + b)) / 2 if a > 2 or b > 2 else base
        want = round(base, 4) * (0.8 if kind == "negative" else 1)
        assert abs(one(scores.after_feedback(F.lit(kind), F.lit(0.9), F.lit(0.5), F.lit(0.7), F.lit(2.0), F.lit(2.0), F.lit(0))) - want) < 1e-4
    trust = lambda n, c, k: round(one(scores.source_trust(F.lit(n), F.lit(c), F.lit(k), rules.SOURCE_BONUS)), 6)
    assert (trust(100, 0, "PDF文档"), trust(5, 9, "图片"), trust(0, 0, "文本"), trust(0, 5, None)) == (0.75, 0.41, 0.5, 0.46)
