"""Operators 4, 9, 10 against brute force and on edge cases."""

import json
import math

import numpy as np
import pytest

from llm import maxscore, tool_calls
from llm.maxscore import exact_top_k
from llm.projections import Cuts, Tree, chi_square_cdf, chi_square_quantile, nearest, ordered
from llm.tool_calls import canonical, check_schema, link, place, validate

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    m = r.standard_normal((600, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    rows += [(600 + k, rows[20][1]) for k in range(30)]  # ties
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] + [0.0] * 15), (760, [None] + [1.0] * 15), (780, [float("inf")] + [0.0] * 15), (800, []), (820, [1.0, 2.0]), (None, rows[0][1])]
    return spark.createDataFrame([(*r, 1, "c", 0.0) for r in rows], SCHEMA)


def table(vectors, zero):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    return [(i, v) for i, v in rows if zero or any(v)]


def test_exact_top_is_brute_force(vectors):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in table(vectors, True)]
    want = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in exact_top_k(vectors).collect()) == sorted(want)


def test_negative_scores_still_count(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [-0.5, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in exact_top_k(df).where("query_id = 0").orderBy("rank").collect()] == [(3, 0), (2, -32768), (1, -65536)]


def test_nearest_has_the_recall(vectors):
    rows, got = table(vectors, False), {}
    for r in nearest(vectors).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = n = 0
    for i, q in rows:
        if i % 20 == 0 and len(q) == 16:
            s = sorted((-float(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == 16)[:20]
            hit += len({j for _, j in s} & {r.vec_id for r in got[i]})
            n += len(s)
            assert [r.rank for r in sorted(got[i], key=lambda r: r.rank)] == list(range(1, 21))
    assert hit / n >= 0.9


def test_empty_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(none).count() == nearest(none).count() == 0


def test_chi_square_and_trees():
    assert abs(chi_square_cdf(15.507, 8) - 0.95) < 1e-4 and abs(chi_square_cdf(14.067, 7) - 0.95) < 1e-4
    assert abs(chi_square_quantile(0.9, 32) - 42.585) < 1e-2
    p = np.random.default_rng(0).standard_normal((1000, 4))
    order, small = ordered(p, 64)
    assert sorted(order.tolist()) == list(range(1000)) and np.bincount(small).max() <= 64
    q, p = np.zeros(4), p[order]
    d = (p**2).sum(axis=1)
    walked = np.concatenate(list(Tree(p, small).walk(q, p, lambda: 2.0)))
    assert walked.tolist() == [i for i in np.argsort(d, kind="stable").tolist() if d[i] < 2.0]
    cuts = Cuts(p, 8)
    leaf = cuts.of(p)
    assert np.bincount(leaf).tolist() == [125] * 8
    assert all(cuts.distance(x)[n] == 0 for x, n in zip(p[:50], leaf[:50], strict=True))
    assert len(Cuts(np.zeros((200, 4)), 8).low) == 1


def many(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def sphere(spark):
    """Three thousand unit vectors without any structure: the hardest table for pruning."""
    m = np.random.default_rng(8).standard_normal((3000, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[1:3000:3] = m[1]  # a hot vector
    return m


@pytest.mark.parametrize(("shard", "share"), [(4096, 1 / 3), (512, 1 / 2)])
def test_projections_stop_early_with_the_recall(spark, sphere, shard, share):
    m = np.delete(sphere, np.arange(4, 3000, 3), axis=0)
    got = nearest(many(spark, enumerate(m)), every=20, k=20, shard=shard).toPandas()
    s = m @ m.T
    np.fill_diagonal(s, -9)
    hit = 0
    for i, x in got.groupby("query_id"):
        assert x.sort_values("rank")["rank"].tolist() == list(range(1, 21)) and i not in set(x.vec_id)
        assert np.allclose(x.score, s[i, x.vec_id], atol=1e-12)
        hit += len(set(np.argsort(-s[i], kind="stable")[:20]) & set(x.vec_id))
    asked = len(range(0, len(m), 20))
    assert got.query_id.nunique() == asked and hit / asked / 20 >= 0.9
    assert got.groupby("query_id").verified.first().mean() < len(m) * share


def test_hot_vector_and_repeated_ids(spark, sphere):
    rows = [*enumerate(sphere), (20, sphere[5]), (1, sphere[1])]
    got = nearest(many(spark, rows), every=1000, k=20, shard=256).toPandas()
    hot = got[got.query_id == 1000].sort_values("rank")
    assert hot.vec_id.tolist() == [1, 1, *range(4, 1 + 3 * 19, 3)] and np.allclose(hot.score, 1)
    exact = exact_top_k(many(spark, rows), every=1000, k=20, shard=256).toPandas()
    assert exact[exact.query_id == 1000].sort_values("rank").vec_id.tolist() == hot.vec_id.tolist()
    twice = exact_top_k(many(spark, [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])]), every=50, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in twice] == [(2, 6 << 16), (2, 3 << 16), (1, 2 << 16)]


def test_postings_prune_what_has_few_components(spark):
    r = np.random.default_rng(4)
    m = np.where(r.random((4000, 64)) < 0.06, r.exponential(0.3, (4000, 64)), 0.0)
    m[::50] *= 2
    df = many(spark, enumerate(m))
    share = maxscore.work(df, shard=1024)
    assert share["met"] < 1 / 3 and share["looked"] < 1 / 4
    d = np.floor(m * 256)
    s = d @ d.T
    np.fill_diagonal(s, -1)
    for i, x in exact_top_k(df, shard=1024).toPandas().groupby("query_id"):
        assert x.sort_values("rank").score.tolist() == np.sort(s[i])[::-1][:5].tolist()


def test_ranges_are_skipped_where_vectors_have_structure(spark):
    r = np.random.default_rng(8)
    centre = r.standard_normal((16, 32))
    m = centre[r.integers(0, 16, 5000)] + 0.15 * r.standard_normal((5000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = many(spark, enumerate(m))
    share = maxscore.work(df, shard=2500)
    assert share["skipped"] > 1 / 2 and share["looked"] < 1 / 4
    d = np.floor(m * 256)
    s = d @ d.T
    np.fill_diagonal(s, -(10**9))
    for i, x in exact_top_k(df, shard=2500).toPandas().groupby("query_id"):
        order = np.lexsort((np.arange(5000), -s[i]))[:5]
        assert x.sort_values("rank")[["vec_id", "score"]].to_numpy().tolist() == [[j, s[i][j]] for j in order]


def test_a_shard_that_a_large_component_enters_stays_exact(spark):
    r = np.random.default_rng(9)
    m = r.standard_normal((400, 6)) * 10.0 ** r.integers(0, 7, (400, 1))
    m[7] = m[8] = m[9]
    d = [[math.floor(256 * x) for x in v] for v in m]
    got = exact_top_k(many(spark, enumerate(m)), every=40, shard=100).orderBy("query_id", "rank").collect()
    want = []
    for i in range(0, 400, 40):
        best = sorted((-sum(a * b for a, b in zip(d[i], v, strict=True)), j) for j, v in enumerate(d) if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert [tuple(x) for x in got] == want


def test_large_components_are_exact_or_an_error(spark):
    big = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 1.0]), (3, [-1e7, 0.0])]
    got = exact_top_k(many(spark, big)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (256 * 10**6) ** 2 + 2 * 256 * 256), (2, (256 * 10**6) ** 2 + 256 * 256), (3, -(256**2) * 10**13)]
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        exact_top_k(many(spark, [(0, [1e20]), (1, [1e20])])).collect()


def test_large_ids_stay_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big * 100, [1.0, 0.5]), (big, [0.5, 1.0]), (None, [1.0, 1.0]), (big + 2, [0.2, 0.1])], "vec_id long, embedding array<double>")
    for got in (exact_top_k(df), nearest(df)):
        assert [(r.query_id, r.vec_id) for r in got.orderBy("rank").collect()] == [(big * 100, big), (big * 100, big + 2)]


def call(i, name="search", args=None, **more):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': {'query': 'q'} if args is None else args, **more})}</tool_call>"


def result(i):
    return f"<tool_result>{json.dumps({'id': i, 'content': 'x'})}</tool_result>"


def test_tool_calls_are_linked_validated_and_ordered(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", "first " + call("b", after=["a"]) + call("a")),
        (1, 2, "tool", result("b") + result("a") + result("zz")),
        (1, 3, "assistant", call("a", "search") + call("c", args={"limit": 5}) + call("d", "nope") + "<tool_call>{oops</tool_call>"),
        (1, 4, "assistant", call("e", after=["f"]) + call("f", after=["e"]) + call("g", args={"query": "q", "limit": 500})),
        (2, 0, "tool", result("a")), (2, 1, "user", None), (2, None, "user", call("q")), (None, 0, "user", result("a")),
    ]
    got = link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    status = {(r.conv_id, r.turn, r.item): (r.kind, r.status) for r in got}
    assert status[1, 1, 1] == ("call", "ok") and status[1, 2, 2] == ("result", "orphan") and status[1, 3, 0] == ("call", "duplicate")
    assert status[1, 3, 1] == ("call", "invalid") and status[1, 3, 2] == ("call", "unknown_tool") and status[1, 3, 3] == ("call", "broken")
    assert status[1, 4, 0] == status[1, 4, 1] == ("call", "cycle") and status[1, 4, 2] == ("call", "invalid")
    assert status[2, 0, 0] == ("result", "orphan") and status[2, 1, 0] == ("text", "ok")
    level = {(r.kind, r.call_id): r.level for r in got if r.conv_id == 1 and r.status == "ok" and r.kind != "text"}
    assert level == {("call", "a"): 1, ("result", "a"): 2, ("call", "b"): 3, ("result", "b"): 4}
    assert all(canonical(json.loads(r.json)) == r.json for r in got) and len(got) == 18


def test_hot_conversation_and_repeats(spark):
    rows = [(7, 1, "assistant", call("a"))] * 40 + [(7, 2, "tool", result("a"))] * 3
    got = link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("kind", "status").count().collect()
    assert {(r.kind, r.status): r["count"] for r in got} == {("call", "ok"): 1, ("call", "duplicate"): 39, ("result", "ok"): 3}
    assert link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("body", [call("a", args={"query": "q", "limit": "N"}).replace('"N"', "1e999"), call("a", args={"query": "q", "limit": "N"}).replace('"N"', "9" * 5000), call("a", args={"query": "N"}).replace('"N"', "[" * 200_000 + "]" * 200_000), call("a", args={"query": "N"}).replace('"N"', '"\\ud800"'), '<tool_result>{"id": "a", "content": -1e999}</tool_result>', call("a", after=["N"]).replace('"N"', '"\\udfff"'), "<tool_call>[1]</tool_call>", '<tool_call>{"id": 7}</tool_call>', "<tool_call>NaN</tool_call>"])
def test_what_has_no_canonical_text_is_broken(spark, body):
    got = link(spark.createDataFrame([(1, 0, "assistant", body), (2, 0, "assistant", call("ok"))], CHAT)).collect()
    assert {(r.conv_id, r.status) for r in got} == {(1, "broken"), (2, "pending")}
    assert all(json.loads(r.json) for r in got)


def test_numbers_have_one_form():
    forms = ['{"x":1}', '{"x":1.0}', '{"x":1e0}', '{"x":10E-1}']
    assert {canonical(json.loads(f)) for f in forms} == {'{"x":1}'}
    assert canonical(json.loads("[1e22, 10000000000000000000000, -0.0, 0.5, true]")) == "[1e+22,1e+22,0,0.5,true]"
    big = "1" * 400
    assert canonical(json.loads(f"[{big}]")) == f"[{big}]" and validate(int(big), {"type": "integer"}) is None


def test_large_ids_of_messages_stay_exact(spark):
    big = 2**53 + 1
    got = link(spark.createDataFrame([(big, big, "assistant", call("a")), (None, None, "user", "x"), (big, big + 2, "tool", result("a"))], CHAT)).collect()
    assert sorted((r.conv_id, r.turn, r.status) for r in got if r.conv_id) == [(big, big, "ok"), (big, big + 2, "ok")]


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "word " * 400_000 + call("a"), "c", 3)]
    got = link(spark.createDataFrame(rows, CHAT + ", status string, level int")).collect()
    assert [(r.kind, r.status, r.level) for r in sorted(got, key=lambda r: r.item)] == [("text", "ok", 0), ("call", "pending", 1)]


@pytest.mark.parametrize("fold", [50_000, 20, 0])
def test_links_of_random_conversations_are_brute_force(spark, monkeypatch, fold):
    import random

    monkeypatch.setattr(tool_calls, "FOLD", fold)
    r = random.Random(11)
    rows, calls, results = [], {}, set()
    for conv in range(12):
        names = [f"n{k}" for k in range(14)]
        for turn in range(14):
            after = r.sample(names, r.choice([0, 0, 1, 2]))
            who = r.choice(names)
            rows.append((conv, turn, "assistant", call(who, r.choice(["search", "nope"]), after=after)))
            calls.setdefault((conv, who), (turn, sorted(set(after)), "nope" in rows[-1][3]))
            if r.random() < 0.6:
                rows.append((conv, turn, "tool", result(w := r.choice(names))))
                results.add((conv, w))
    level = {}
    for _ in calls:
        for (conv, i), (turn, after, _) in calls.items():
            deps = [level.get((conv, a)) for a in after if (conv, a) in calls]
            if (conv, i) not in level and None not in deps:
                level[conv, i] = max([x + 2 for x in deps], default=1)
    seen = set()
    for x in sorted(link(spark.createDataFrame(rows, CHAT)).collect(), key=lambda x: (x.conv_id, x.turn, x.kind)):
        key = (x.conv_id, x.call_id)
        if x.kind == "call" and key not in seen:
            seen.add(key)
            want = "cycle" if key not in level else "unknown_tool" if calls[key][2] else "ok" if key in results else "pending"
            assert (x.turn, x.status, x.level) == (calls[key][0], want, level.get(key, 0))
        elif x.kind == "call":
            assert (x.status, x.level) == ("duplicate", 0)
        elif x.kind == "result":
            assert x.status == ("ok" if key in calls else "orphan") and x.level == (level[key] + 1 if key in level else 0)


def test_validate():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "k": {"type": ["string", "null"]}, "l": {"type": "array", "items": {"enum": [1, 2]}}}, "required": ["n"], "additionalProperties": False}
    assert validate({"n": 1, "k": None, "l": [1]}, s) is None
    assert [validate(x, s) for x in ({}, {"n": 0}, {"n": True}, {"n": 1, "z": 1}, {"n": 1, "l": [3]}, [])] == ["$.n: missing", "$.n: out of range", "$.n: not integer", "$.z: not known", "$.l[0]: not in enum", "$: not object"]
    assert [validate(x, {"enum": [1, "a", None]}) for x in (1.0, "a", None)] == [None] * 3
    assert validate(True, {"enum": [1]}) and validate(1, {"enum": [True]})
    assert [validate(x, {"minLength": 2, "maxLength": 3}) for x in ("ab", "abc", 7)] == [None] * 3 and validate("a", {"minLength": 2}) and validate("abcd", {"maxLength": 3})


@pytest.mark.parametrize("schema", [{"type": "text"}, {"pattern": "a"}, {"properties": {"x": {"anyOf": []}}}, {"items": [1]}, {"additionalProperties": {"type": ["string", "date"]}}, 7])
def test_schemas_that_cannot_be_held_are_refused(spark, schema):
    with pytest.raises(ValueError):
        link(spark.createDataFrame([(1, 0, "user", "x")], CHAT), {"tool": schema})
    for good in tool_calls.SCHEMAS.values():
        check_schema(good | {"description": "x"})


def test_long_chains_take_no_rounds(spark):
    n = 1000
    rows = [(1, k, "assistant", call(f"c{k}", after=[f"c{k - 1}"] if k else [])) for k in range(n)]
    rows += [(2, n - k, "assistant", call(f"c{k}", after=[f"c{k - 1}"] if k else ["c9"])) for k in range(n)]
    got = {(r.conv_id, r.call_id): (r.status, r.order_turn, r.level) for r in link(spark.createDataFrame(rows, CHAT)).collect()}
    assert all(got[1, f"c{k}"] == ("pending", k, 2 * k + 1) and got[2, f"c{k}"][::2] == ("cycle", 0) for k in range(n))
    back = place([(f"c{k}", n - k, [f"c{k - 1}"] if k else []) for k in range(n)][::-1])
    assert back == [(f"c{k}", n, 2 * k + 1) for k in range(n)]


def test_marks_inside_of_strings_and_marks_without_an_end(spark):
    inner = call("a", args={"query": "x</tool_call>y<tool_call>"})
    rows = [(1, 0, "assistant", "go " + inner + " on"), (1, 1, "tool", result("a") + "<tool_call>{no end"), (2, 0, "assistant", "<tool_result>" * 3 + call("b")), (3, 0, "assistant", '<tool_call>{"id": "x"} more</tool_call>')]
    got = [(r.conv_id, r.turn, r.item, r.kind, r.status) for r in link(spark.createDataFrame(rows, CHAT)).orderBy("conv_id", "turn", "item").collect()]
    assert got == [(1, 0, 0, "text", "ok"), (1, 0, 1, "call", "ok"), (1, 0, 2, "text", "ok"), (1, 1, 0, "result", "ok"), (1, 1, 1, "text", "ok"), (2, 0, 0, "text", "ok"), (2, 0, 1, "call", "pending"), (3, 0, 0, "call", "broken")]
