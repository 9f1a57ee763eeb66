"""Operators 2, 3, 5, 7 and the pipeline against plain Python versions of the whole."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import one_of_each, shingles

from llm.kd_shards import LOOSE, kd_shards
from llm.mixing import SEED, mix
from llm.packing import pack
from llm.ppm import Trees, _counts, identify

SF = "/root/testdata/sf0.001"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# operator 2

def plain_bins(parts, capacity, per_source):
    """Of parts (size, source, cluster), largest first, the bin of each: every open bin is looked at."""
    bins, out = [], []
    for size, source, cluster in parts:
        fit = [(capacity - sum(s for s, _, _ in b), k) for k, b in enumerate(bins)]
        fit = [(room, k) for room, k in fit if room >= size and all(c != cluster for _, _, c in bins[k]) and sum(s == source for _, s, _ in bins[k]) < per_source]
        k = min(fit)[1] if fit else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((size, source, cluster))
        out.append(k)
    return out


def assert_packed_plainly(got, capacity, per_source):
    shards = defaultdict(list)
    for r in got:
        assert (r.bin is None) == (r["size"] == 0)
        if r.bin:
            shards[r.bin.split("-")[0]].append(r)
    for number, rows in shards.items():
        rows.sort(key=lambda r: (-r["size"], r.doc_id is None, r.doc_id or 0, r.part, r.cluster))
        want = plain_bins([(r["size"], r.source, r.cluster) for r in rows], capacity, per_source)
        # rows alike in id, part and cluster may change places
        name = lambda r, b: (r.doc_id, r.part, r.cluster, r["size"], b)
        assert Counter(name(r, r.bin) for r in rows) == Counter(name(r, f"{number}-{b}") for r, b in zip(rows, want, strict=True))
    return len(shards)


@pytest.mark.parametrize(("capacity", "per_source", "shard"), [(200, 2, 50), (90, 1, 1000), (4096, 4, 20)])
def test_packing_is_that_of_looking_at_every_bin(docs, rows, capacity, per_source, shard):
    got = pack(docs, capacity=capacity, per_source=per_source, shard=shard).collect()
    assert assert_packed_plainly(got, capacity, per_source) == -(-len(rows) // shard)
    # a text of more words than a bin holds fills bins of its own
    parts = Counter((r.doc_id, r["size"]) for r in got)
    want = Counter((i, min(capacity, max(0, words(t) - k * capacity))) for i, t in rows for k in range(max(1, -(-words(t) // capacity))))
    assert parts == want


def test_registered_packing_has_the_clusters_of_all_pairs(spark):
    from llm.queries import op2_best_fit_packing

    got = op2_best_fit_packing(spark, SF).collect()
    assert_packed_plainly(got, 4096, 4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets, root = [shingles(t, 5) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = lambda pairs: sorted(sorted(g) for g in pairs.values())
    mine, want = defaultdict(set), defaultdict(set)
    for r in got:
        if r["size"]:
            mine[r.cluster].add(r.doc_id)
    for k, (i, _) in enumerate(docs):
        if sets[k]:
            want[find(k)].add(i)
    assert classes(mine) == classes(want) and max(map(len, want.values())) > 1


# operator 3

def plain_targets(sizes):
    """Sources in order share 150 % by 3, 1, 2; twice a source's size is the most, and the excess goes round until none is above."""
    got, weight = [0.0] * len(sizes), [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    capped = {k for k, s in enumerate(sizes) if not s}
    while True:
        rest = 1.5 * sum(sizes) - sum(got[k] for k in capped)
        free = [k for k in range(len(sizes)) if k not in capped]
        for k in free:
            got[k] = rest * weight[k] / sum(weight[j] for j in free)
        over = [k for k in free if got[k] > 2 * sizes[k]]
        if not over:
            return got
        for k in over:
            got[k] = 2.0 * sizes[k]
        capped |= set(over)


def best_sum(counts, budget):
    """What a source takes of its lengths for a budget: each length's share of it, rounded down, then the best sum of what is left of them."""
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return total
    base = {s: n * budget // total for s, n in counts.items()}
    got = sum(s * n for s, n in base.items())
    reach = 1
    for s, n in counts.items():
        for _ in range(n - base[s]):
            reach |= reach << s
    room = budget - got
    return got + (reach & ((1 << room + 1) - 1)).bit_length() - 1


def assert_mixed_plainly(docs, got):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.xxhash64(F.lit(SEED).cast("long"), F.col("doc_id").cast("long"), "text").alias("draw")).collect()
    draw = lambda x: x & (1 << 64) - 1
    by, mine = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.source].append((words(r.text), r))
    for r in got:
        mine[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for n, _ in by[s]) for s in order]
    for source, size, target in zip(order, sizes, plain_targets(sizes), strict=True):
        assert len(mine[source]) == len(by[source])
        assert all(r.source_size == size and math.isclose(r.target, target, rel_tol=1e-12) for r in mine[source])
        passes = min(2, int(target // size)) if size else 0
        budget = round(target - passes * size)
        counts = Counter(n for n, _ in by[source] if n)
        assert sum(r.taken for r in mine[source]) == passes * size + (best_sum(counts, budget) if counts else 0)
        # of each length those of the lowest draw
        for n in counts:
            taken = sorted(((r.doc_id is None, r.doc_id or 0), r.taken) for r in mine[source] if r["size"] == n)
            more = sum(t // n - passes for _, t in taken)
            ranked = sorted((x for x in by[source] if x[0] == n), key=lambda x: (draw(x[1].draw), x[1].doc_id is not None, x[1].doc_id or 0))
            want = sorted(((r.doc_id is None, r.doc_id or 0), n * (passes + (k < more))) for k, (_, r) in enumerate(ranked))
            assert taken == want
        assert all(r.taken == 0 for r in mine[source] if r["size"] == 0)


def test_mix_is_that_of_plain_python(spark, docs):
    assert_mixed_plainly(docs, mix(docs).collect())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert_mixed_plainly(table, mix(table).collect())


# operator 5

def plain_shards(units, shards):
    """The shard of each unit (hash, weight, dimensions, what parts equal ones): sorted along the widest dimension, cut at the median of weight."""
    spans = lambda of: [max(u[2][d] for u in of) - min(u[2][d] for u in of) for d in range(4)]
    whole, out = [max(1, x) for x in spans(units)], {}

    def split(of, first, count):
        if count == 1 or not of:
            out.update((u[0], first) for u in of)
            return
        share = [x / w for x, w in zip(spans(of), whole, strict=True)]
        d = share.index(max(share))
        of = sorted(of, key=lambda u: (u[2][d], u[3]))
        left, below, at = count // 2 / count * sum(u[1] for u in of), 0, 0
        while below + of[at][1] < left:
            below += of[at][1]
            at += 1
        at += left - below > below + of[at][1] - left
        split(of[:at], first, count // 2)
        split(of[at:], first + count // 2, count - count // 2)

    split(units, 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_are_those_of_a_tree_by_sorting(spark, shards):
    r = random.Random(11)
    rows = [(r.randrange(10**6), f"text {k} " * r.randrange(5, 12), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for k in range(40 * shards)]
    rows += [(None, "no id here " * 4, "en", "a"), (5, "twice and twice " * 3, "de", "b"), (6, "twice and twice " * 3, "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size, crc = (F.octet_length("text") + 16).cast("long"), F.crc32("text").cast("long")
    unit = F.xxhash64(F.xxhash64("text"), crc, size)
    known = df.select("doc_id", "text", size.alias("size"), unit.alias("unit"), F.shiftrightunsigned(F.xxhash64(unit), 33).alias("part"), *[F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 33), F.lit(0)).alias(c) for c in ("source", "lang")]).collect()
    low, groups = min(x.doc_id for x in known if x.doc_id is not None), defaultdict(list)
    for x in known:
        groups[x.unit].append(x)
    units = []
    for unit, of in groups.items():
        first = min(of, key=lambda x: (x.doc_id is not None, x.doc_id or 0))
        units.append((unit, sum(x["size"] for x in of), (first["size"], first.source, first.lang, 0 if first.doc_id is None else first.doc_id - low + 1), first.part))
    want = plain_shards(units, shards)
    got = kd_shards(df, shards=shards, even=None).collect()
    assert Counter((x.doc_id, x["size"], x.shard) for x in got) == Counter((x.doc_id, x["size"], want[x.unit]) for x in known)


def test_few_units_move_until_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tree, moved = ({(r.doc_id, r.text_crc32): r for r in kd_shards(docs, shards=40, even=x).collect()} for x in (None, 1 / 100))

    def off(got):
        load = Counter()
        for r in got.values():
            load[r.shard] += r["size"]
        mean = sum(load.values()) / 40
        return len(load), max(abs(x - mean) for x in load.values()) / mean

    assert off(tree)[0] == off(moved)[0] == 40 and off(moved)[1] < 0.02 < off(tree)[1]
    assert sum(tree[k].shard != r.shard for k, r in moved.items()) < len(tree) / 4
    texts, weight = defaultdict(set), Counter()
    for r in moved.values():
        texts[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r["size"]
    hot = sum(weight.values()) / 40 / LOOSE
    assert all(len(x) == 1 for c, x in texts.items() if weight[c] <= hot)  # copies that aren't hot stay together
    slots = defaultdict(list)
    for r in moved.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# operator 7

class PlainTree:
    """A language's bytes after their last three, two, one and none, as dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            b = b"\n\n\n" + t.encode()
            for i in range(3, len(b)):
                for o in range(4):
                    self.seen[b[i - o : i]][b[i]] += 1
        self.held = {}

    def chances(self, context):
        """Of each byte after a context: its share of what was seen there; what escapes goes to the others by the shorter context."""
        if context not in self.held:
            low = self.chances(context[1:]) if context else [1 / 256] * 256
            seen = self.seen.get(context)
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                rest = sum(p for x, p in enumerate(low) if x not in seen)
                low = [seen[x] / (n + kinds) if x in seen else p * kinds / (n + kinds) / rest for x, p in enumerate(low)]
            self.held[context] = low
        return self.held[context]

    def bits(self, text):
        b = b"\n\n\n" + text.encode()
        runs = Counter(b[i - 3 : i + 1] for i in range(3, len(b)))
        return -sum(n * math.log2(self.chances(r[:3])[r[3]]) for r, n in runs.items())


def test_code_lengths_are_those_of_plain_trees(spark, docs, rows):
    learn = [("en", "the cat sat on the mat"), ("en", "the dog and the cat"), ("de", "der hund lag auf dem bett"), ("de", "die katze saß dort"), ("ru", "кот сидел на коврике"), ("aa", "the cat sat on the mat"), ("aa", "the dog and the cat")]
    frame = spark.createDataFrame([(x, t, k) for k, (x, t) in enumerate(learn)], "lang string, text string, pick long")
    trees = Trees(_counts(frame.select("lang", "text")))
    plain = {x: PlainTree([t for y, t in learn if y == x]) for x in sorted({x for x, _ in learn})}
    assert trees.langs == list(plain)
    texts = [t for _, t in rows if t] + ["the cat", "der hund", "кот", "saß", "日本 \x00\x7f", "é", "alpha3"]
    want = np.array([[p.bits(t) for p in plain.values()] for t in texts])
    assert np.allclose(trees.code_lengths(texts), want, rtol=1e-5, atol=1e-3)
    # the shared fixture, repeated rows, clashing columns and very long texts among it, and a tie of two languages
    extra = spark.createDataFrame([(200 + k, t) for k, t in enumerate(texts[-7:])], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = identify(docs.unionByName(extra, allowMissingColumns=True), frame).collect()
    best = {}
    for i, t in {(r.doc_id, r.text) for r in every.collect()}:
        if t and re.search(r"[^\W\d_]", t):
            bits = [p.bits(t) for p in plain.values()]
            near = sorted(b - min(bits) for b in bits)
            best.setdefault(i, set()).add((trees.langs[int(np.argmin(np.round(bits, 2)))], round(1 / sum(2.0**-x for x in near), 3)))
        else:
            best.setdefault(i, set()).add(("und", 0.0))
    assert len(got) == every.count()
    for r in got:
        assert any(r.lang_pred == x and abs(r.score - s) < 0.01 for x, s in best[r.doc_id]), (r, best[r.doc_id])
    assert {"aa", "de", "ru", "und"} <= {r.lang_pred for r in got} and not any(r.lang_pred == "en" for r in got)


# the pipeline

def test_pipeline_is_that_of_plain_stages(spark, tmp_path):
    import corpus_pipeline as p
    from llm.importance import keep_sampled

    stage = dict(p.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = []
    for k, (name, f) in enumerate(p.STAGES):
        f(spark, held[-1] if held else docs, SF).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    assert list(stage) == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources", "best-fit packing"]
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    good, alone, private, mixed, packed = held
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert sorted(map(str, pairs(good))) == sorted(map(str, pairs(keep_sampled(docs, labels))))
    assert sorted(map(str, pairs(alone))) == sorted(map(str, one_of_each(pairs(good), 5, 8, 10)))
    assert sorted(i for i, _ in pairs(private)) == sorted(i for i, _ in pairs(alone))
    counted = mix(private).collect()
    assert_mixed_plainly(private, counted)
    text = dict(pairs(private))
    times = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in counted}
    assert Counter(pairs(mixed)) == Counter({(i, text[i]): n for i, n in times.items() if n})
    assert_packed_plainly(packed.collect(), 4096, 4)
    whole = defaultdict(list)
    for r in packed.collect():
        whole[r.doc_id].append((r.part, r.text))
    for i, n in times.items():
        assert sorted(x for x, _ in whole[i]) == sorted(list(range(max(1, -(-words(text[i]) // 4096)))) * n)
        assert not n or "".join(t for _, t in sorted(set(whole[i]))) == text[i]
