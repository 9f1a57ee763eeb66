"""Operators 11 to 13 against plain versions that share no code with them."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import conversation_repair, fingerprints, target_resampling
from llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"

# ---- 11


def plain_repair(rows):
    """conv_id -> the result's row, by a table of least (cost, letters) over all places and states."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        convs[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, kinds = Counter(), set(), []
        for _, role, text in held:
            end = text.strip(" \t\n\v\f\r")[-1:]
            kind = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
            seen.add((role, text))
            counts[kind] += 1
            kinds.append(kind)
        best = {(0, ""): (0, "", ())}  # (row, output initials so far reduced to a state) -> cost, letters, rows

        def state(initials):
            return "" if not initials else initials[-1]

        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        def put(table, key, value):
            if key not in table or value[:2] < table[key][:2]:
                table[key] = value

        def inserted(table, i):
            for _ in range(3):
                for q in ("", "s", "u", "a"):
                    if (i, q) in table:
                        c, a, t = table[i, q]
                        for x in after[q]:
                            if x != "s":
                                put(table, (i, x), (c + 5, a + "I", (*t, ("user:" if x == "u" else "assistant:"))))

        for i, ((_, role, text), kind) in enumerate(zip(held, kinds, strict=True)):
            inserted(best, i)
            for q in ("", "s", "u", "a"):
                if (i, q) not in best:
                    continue
                c, a, t = best[i, q]
                put(best, (i + 1, q), (c + 2, a + "D", t))
                if kind not in ("blank", "duplicate"):
                    more = 5 if kind == "truncated" else 0
                    x = role[:1]
                    if x in after[q]:
                        put(best, (i + 1, x), (c + more, a + "K", (*t, f"{role}:{text}")))
                    for full in ("user", "assistant"):
                        if full[0] in after[q]:
                            put(best, (i + 1, full[0]), (c + 1 + more, a + "R", (*t, f"{full}:{text}")))
        n = len(held)
        inserted(best, n)
        cost, letters, lines = min((best[n, q] for q in ("", "a") if (n, q) in best), key=lambda x: x[:2])
        turns = {t for t, _, _ in held if t is not None}
        firsts = [r[1][:1] for r in held]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(firsts)), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    got = conversation_repair.repair(spark.createDataFrame(rows, CONV + ", cost string, part int").select("*") if rows and len(rows[0]) == 6 else spark.createDataFrame(rows, CONV)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def talk(r, conv, n):
    roles = ["user", "assistant", "assistant", "user", "system", "User", "", None]
    texts = ["Yes.", "No", "What?", "  ", None, "Fine!\n", "long " * 50 + "end.", "..", "\x0b\t", "a. b"]
    return [(conv, r.choice([None, *range(n)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def test_repair_of_odd_conversations(spark):
    r = random.Random(4)
    rows = [x for c in range(120) for x in talk(r, c, r.randrange(1, 12))] + talk(r, None, 9) + [(1 << 60, 0, "user", "Hi."), ((1 << 60) + 1, 0, "user", "Hi.")]
    rows = [(*x, "c", 1) for x in rows]
    r.shuffle(rows)
    assert repaired(spark, rows) == plain_repair([x[:4] for x in rows])


def test_repair_of_one_long_conversation_over_many_partitions(spark):
    r = random.Random(9)
    roles, texts = ["user", "assistant"], [f"Text {k}." for k in range(900)] + ["cut off", ""]
    rows = [(7, k, roles[k % 2] if r.random() < 0.9 else r.choice([*roles, "system"]), r.choice(texts)) for k in range(4000)]
    rows += [(7, None, "system", "Start.")] + [(8, 1, "user", "Same.")] * 2500 + [x for c in range(20, 40) for x in talk(r, c, 6)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark, rows) == plain_repair(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_repair_of_an_empty_table(spark):
    assert repaired(spark, []) == {}


def least(codes, ends, last, state):
    """Cheapest way by trying every way with at most two insertions between rows."""
    def ways(i, q, run):
        if i == len(codes):
            if last:
                if q in (conversation_repair.START, conversation_repair.ASSISTANT):
                    yield 0, "", q
            elif ends[q] < conversation_repair.NEVER:
                yield ends[q], "", q
        if (i < len(codes) or last) and run < 2:
            for c, a, z in ways(i, 3 if q == 2 else 2, run + 1):
                yield c + 5, "I" + a, z
        if i < len(codes):
            role, fault = codes[i]
            for c, a, z in ways(i + 1, q, 0):
                yield c + 2, "D" + a, z
            if fault in "03":
                more = 5 * (fault == "3")
                for c, a, z in ways(i + 1, 3 if q == 2 else 2, 0):
                    yield c + 1 + more, "R" + a, z
                to = {"s0": 1, "u0": 2, "u1": 2, "u3": 2, "a2": 3}.get(f"{role}{q}")
                if to is not None:
                    for c, a, z in ways(i + 1, to, 0):
                        yield c + more, "K" + a, z

    return min(ways(0, state, 0), default=(conversation_repair.NEVER, "", state))


def test_the_auction_finds_the_least_of_all_ways():
    r = random.Random(2)
    never = conversation_repair.NEVER
    for _ in range(150):
        codes = tuple(r.choice("suaa?u") + r.choice("0001233") for _ in range(r.randrange(0, 5)))
        last, q = r.random() < 0.5, r.randrange(4)
        ends = conversation_repair._END if last else tuple(r.choice([never, r.randrange(9)]) for _ in range(4))
        if min(ends) == never:
            continue
        want = least(codes, ends, last, q)
        got = conversation_repair.trace(codes, ends, last, q)
        assert got[0] == want[0] and (want[0] == never or got == want), (codes, ends, last, q)


def test_blocks_fold_to_the_whole():
    r = random.Random(3)
    codes = [r.choice("uuaas?") + r.choice("00000123") for _ in range(150)]
    whole = conversation_repair.trace(tuple(codes), conversation_repair._END, True, 0)
    assert conversation_repair.way(codes, (), True, 0) == whole
    assert conversation_repair.before(conversation_repair.table_of(codes), conversation_repair.end_prices())[0] == whole[0]


# ---- 12


def plain_draw(docs, target):
    def words(text):
        out, word = [], ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
                word += c
            else:
                out += [word] if word else []
                word = ""
        return out

    def buckets(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[0])
    for text in target:
        t.update(buckets(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, text in docs:
        f, n = buckets(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    long = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    drawn = len(long) * 25 // 100
    ranks = {id(r): k + 1 for k, r in enumerate(long[:drawn])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=str)


def test_draw_is_the_plain_one(spark, docs, rows):
    target = [" ".join(t.split()[:40]) for _, t in rows[:12]] + [None, "", "Alpha1 ÄÖ\x00beta2"]
    got = target_resampling.draw(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain_draw(rows, target)


def test_draw_of_texts_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(target_resampling, "CHUNK", 50)
    texts = [" ".join(f"w{k % 7}\x00ö" for k in range(n)) for n in (0, 1, 3, 40, 200)] + ["x" * 500, "a b", "B c", None]
    for text in texts:
        whole = [x for pair in target_resampling.features([text, "a b"]) for x in zip(*pair, strict=True)]
        monkeypatch.setattr(target_resampling, "CHUNK", 1 << 21)
        assert sorted(whole) == sorted(x for pair in target_resampling.features([text, "a b"]) for x in zip(*pair, strict=True))
        monkeypatch.setattr(target_resampling, "CHUNK", 50)


def test_draw_without_rows(spark, none, docs):
    empty = spark.createDataFrame([], "text string")
    assert target_resampling.draw(none, empty).count() == 0
    got = target_resampling.draw(docs.select("doc_id", "text"), empty).collect()
    assert len(got) == docs.count()


# ---- 13


def plain_names(text: bytes):
    """The set of names by loops over one text; hashes by the module's mixing of whole numbers."""
    m = (1 << 64) - 1

    def mix(x):
        return int(fingerprints.mix(np.array([x & m], np.uint64))[0])

    def toss(left, x):
        k = ((left ^ x) & -(left ^ x)).bit_length() - 1
        return 2 * k + ((x >> k) & 1)

    symbols, level, found = list(text), 0, set()
    while symbols:
        items = [(x, len(list(g))) for x, g in itertools.groupby(symbols)]
        label = [x for x, _ in items]
        for _ in range(3 if level == 0 else 4):
            label = [toss(label[k - 1] if k else label[0] ^ 1, x) for k, x in enumerate(label)]
        assert max(label) < 6 and all(a != b for a, b in itertools.pairwise(label))
        groups = []
        for k, item in enumerate(items):
            if k == 0 or (k < len(items) - 1 and label[k] > label[k - 1] and label[k] > label[k + 1]):
                groups.append([])
            groups[-1].append(item)
        symbols = [mix(sum(mix(x * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F + (p + 1) * 0x165667B19E3779F9) for p, (x, n) in enumerate(g))) for g in groups]
        level += 1
        if level >= 2 or len(symbols) == 1:
            found |= {mix(x + level) for x in symbols}
        if len(symbols) == 1:
            break
    return found


def test_names_are_the_plain_ones():
    r = random.Random(8)
    texts = [b"", b"a", b"aa", b"ab", b"aaaaaaaabbbb", "Größe 12 – ä".encode(), bytes(r.randrange(256) for _ in range(3000)), b"ab" * 400, *(" ".join(r.choice(["eins", "zwei", "drei"]) for _ in range(n)).encode() for n in (1, 5, 90))]
    name, text = fingerprints.names(texts)
    for k, x in enumerate(texts):
        assert set(name[text == k].tolist()) == plain_names(x), x
    assert [fingerprints.written(s).hex() for s in fingerprints.sketches(texts)] == ["".join(f"{v:08x}" for v in sorted({n >> 32 for n in plain_names(x)})[: fingerprints.KEPT]) for x in texts]


def test_equal_substrings_share_names_wherever_they_stand():
    r = random.Random(1)
    middle = bytes(r.randrange(97, 123) for _ in range(5000))
    made = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    a, b = made(777) + middle + made(50), made(12) + middle + made(3000)
    own, shared = plain_names(middle), plain_names(a) & plain_names(b)
    assert len(own & shared) > 0.9 * len(own)


def plain_edits(rows):
    texts = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, text) in enumerate(texts):
        n, after = len(text) // 3, texts[(k + 1) % len(texts)][1]
        out.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_edits_meet_the_next_document(spark, parts):
    r = random.Random(6)
    rows = [(k * 3 - 50, r.choice([None, "", "é" * 10, " ".join(r.choice("abcdef") * 3 for _ in range(r.randrange(60)))])) for k in range(300)] + [((1 << 60) + 1, "big"), (1 << 60, "big too")]
    want = plain_edits(sorted(rows, key=lambda x: -x[0]))
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.edited(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, part int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == sorted(want)
    by = {}
    for g in got:
        by.setdefault(dict(rows)[g.doc_id] or "", set()).add(g.fingerprint)
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_prints_of_odd_rows(spark, docs, none):
    got = fingerprints.edited(docs).collect()
    assert len(got) == docs.count()
    assert len({g.fingerprint for g in got if g.doc_id in range(80, 85)}) == 1
    assert fingerprints.edited(none).count() == 0
    alone = fingerprints.edited(spark.createDataFrame([(5, "all by itself, twice the same")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs.where("doc_id < 80")).collect()}.items() <= {g.doc_id: g.fingerprint for g in got}.items()


def test_likeness_tells_edited_from_strange(spark):
    got = [g for g in QUERIES["op13_document_fingerprints"](spark, SF).collect() if g.n_chars > 300]
    assert np.quantile([g.near_edited for g in got], 0.05) > 0.45
    assert np.quantile([g.near_next for g in got], 0.95) < 0.2


def test_scopes_delete_what_their_own_thread_settled(spark):
    import os
    import threading

    from llm.common import scratch, settle

    there = lambda df: os.path.exists(df._settled_path.removeprefix("file://"))
    other = []
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            gone, passed, kept = settle(spark.range(3)), inner(settle(spark.range(3))), outer(inner(settle(spark.range(4))))
            t = threading.Thread(target=lambda: other.append(settle(spark.range(5))))
            t.start()
            t.join()
        assert not there(gone) and there(passed) and there(kept)
    assert not there(passed) and there(kept) and there(other[0]) and kept.count() == 4
