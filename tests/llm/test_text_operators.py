"""Operators 1, 6, 7, 8 against brute force and on edge cases."""

import datetime
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from llm.importance import SHARE, gumbel, keep_sampled, kth_highest, resample, sample, threshold
from llm.jaccard_join import heavy_shingles, keep_one_of_each, ngram_jaccard_components, refined
from llm.ppm import Trees, identify
from llm.pseudonyms import pseudonymise
from llm.shingles import PIECE, shingle_sets, words_of_batch


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_count_like_sets(rows, width):
    for (_, t), s in zip(rows, shingle_sets([t for _, t in rows], width), strict=True):
        assert len(s) == len(shingles(t, width))


def test_words_of_pieces_are_those_of_the_whole():
    text = "word " * (PIECE // 3) + "end"
    h, at = words_of_batch([text, "word end"])
    assert at.tolist() == [0, PIECE // 3 + 1, PIECE // 3 + 3] and set(h[:-2]) == set(h[-2:])


@pytest.mark.parametrize(("width", "num", "den", "work"), [(3, 90, 100, {}), (5, 8, 10, {}), (3, 90, 100, {"block": 16}), (5, 8, 10, {"block": 16, "counters": 8}), (3, 1, 2, {"block": 16, "counters": 64})])
def test_jaccard_join_is_brute_force(docs, rows, width, num, den, work):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = ngram_jaccard_components(docs, width, num, den, **work).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((i, find(i)) for i, _ in sets)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)
    kept = keep_one_of_each(docs, width, num, den)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, one_of_each(rows, width, num, den)))


def one_of_each(rows, width, num, den):
    """Of rows linked by their own texts the one of the smallest id; of rows alike in id and text one."""
    rows = sorted({(i, t if re.search(r"[^\x20\x09-\x0D]", t or "") else t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return [r for k, r in enumerate(rows) if find(k) == k]


@pytest.mark.parametrize("counters", [8, 1 << 18])
def test_refined_family_keeps_only_what_is_alike(spark, counters):
    """Texts chained by passages that every one of them has, with a pair of near copies among each ten."""
    shared = [" ".join(f"s{p}x{k}" for k in range(9)) for p in range(4)]
    own = [[f"o{i}x{k}" for k in range(40)] for i in range(120)]
    for i in range(1, 120, 10):
        own[i] = [*own[i - 1][:39], f"o{i}"]
    rows = [(i, " ".join([*own[i], *shared])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    members = docs.selectExpr("doc_id", "0L as family", "74L as n")
    got = refined(docs, members, 3, 90, 100, heavy_shingles(docs, 3, counters), 6).collect()
    assert sorted((r.doc_id, r.family) for r in got) == sorted((i + k, i) for i in range(0, 120, 10) for k in (0, 1))
    found = ngram_jaccard_components(docs, 3, 90, 100, block=64, counters=counters).where("doc_id <> component_id").collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i + 1, i) for i in range(0, 120, 10)]


def test_large_family_and_long_lists(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + [f"own{k}"] + base[k + 1 :])) for k in range(80)]
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
    assert {r.component_id for r in got.collect()} == {0}


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learn = none.select("lang", "text", F.lit(1).cast("long").alias("pick"))
    for df in (ngram_jaccard_components(none), keep_one_of_each(none), pseudonymise(none, KEY), resample(none, labels), sample(none, labels), keep_sampled(none, labels), identify(none, learn)):
        assert df.count() == 0


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_formats_links_and_the_rest(spark):
    text = "Mail ab.12@x.org, card 4961143020124266 and 4961 1430 2012 4266, bad 4961143020124267, ip 10.2.3.4 not 10.2.3.400, call +1 (375) 555-4393, on 2024-02-29 not 2024-02-30, DE89370400440532013000 123-45-6789"
    rows = [(1, text), (2, "card: 4961143020124266"), (3, None), (4, ""), (5, "nothing here 42"), (1, text)]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    by = {r.doc_id: r for r in got}
    new = by[1].text
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
    assert shape(re.sub(r"ip \S+", "", new)) == shape(re.sub(r"ip \S+", "", text))
    card = re.search(r"card (\d{16})", new)[1]
    assert luhn(card) and card != "4961143020124266" and " ".join(re.findall("....", card)) in new and card in by[2].text
    for gone in ("ab.12@", "10.2.3.4 ", "555-4393", "2024-02-29", "DE89370400440532013000", "123-45-6789"):
        assert gone not in new
    for kept in ("4961143020124267", "10.2.3.400", "2024-02-30", "@x.org"):
        assert kept in new
    assert (by[3].text, by[4].text, by[5].text, by[3].n_private, by[5].n_private) == (None, "", "nothing here 42", 0, 0)
    assert by[1].n_private == 8 and len(got) == 6


KEY = "a key for the tests"


def plain_text(value, tag):
    """The Feistel network over characters, in plain Python."""
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(1, 9):
        h = hashlib.sha256(f"{KEY}|{tag}|{r}|{b}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            k = int(h[i % 32 * 2 : i % 32 * 2 + 2], 16)
            first, n = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else (c, 1)
            out += chr(ord(first) + (ord(c) - ord(first) + k) % n)
        a, b = b, out
    return a + b


def plain_pair(a, b, n_a, n_b, tag):
    for r in range(1, 9):
        h = lambda x: int(hashlib.sha256(f"{KEY}|{tag}|{r}|{x}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        a, b = ((a + h(b)) % n_a, b) if r % 2 else (a, (b + h(a)) % n_b)
    return a, b


def poured(layout, digits, kind=str.isdigit):
    it = iter(digits)
    return "".join(next(it) if kind(c) else c for c in layout)


def plain_card(m):
    body = plain_text(re.sub(r"\D", "", m)[:-1], "card")
    return poured(m, body + next(d for d in "0123456789" if luhn(body + d)))


def plain_ten(d):
    area, rest = int(d[:3]), int(d[3:])
    low_a, low_b = 200 * (area >= 200), 2_000_000 * (rest >= 2_000_000)
    a, b = plain_pair(area - low_a, rest - low_b, 800 if low_a else 200, 8_000_000 if low_b else 2_000_000, "nanp")
    return f"{a + low_a:03}{b + low_b:07}"


def plain_iban(m):
    solid = m.replace(" ", "")
    bban = plain_text(solid[4:], "iban")
    number = int("".join(str(int(c, 36)) for c in bban + solid[:2] + "00"))
    return poured(m, f"{solid[:2]}{98 - number % 97:02}{bban}", str.isalnum)


def plain_date(m):
    n = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
    size, base, rows = (292, 0, 250) if n < 73000 else (7, 73000, 7)
    a, b = plain_pair((n - base) // size, (n - base) % size, rows, size, "date")
    return str(datetime.date(1900, 1, 1) + datetime.timedelta(base + a * size + b))


def plain_ip(m):
    p = [int(x) for x in m.split(".")]
    a, b = plain_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def plain_ssn(m):
    area, group, serial = map(int, m.split("-"))
    a, b = plain_pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    return f"{a // 99 + 1 + (a // 99 + 1 > 665):03}-{a % 99 + 1:02}-{b + 1:04}"


def plain_mail(m):
    local, at, domain = m.partition("@")
    return "".join(plain_text(local[i : i + 64], f"email{i // 64}") for i in range(0, len(local), 64)) + at + domain


def abroad(m, code):
    digits = re.sub(r"\D", "", m).removeprefix("00")
    return poured(m, "00" * m.startswith("00") + code + plain_text(digits[len(code) :], f"phone{code}"))


def plain_french(m):
    d = re.sub(r"\D", "", m)
    a, b = plain_pair(int(d[1]) - 1, int(d[2:]), 9, 10**8, "french")
    return poured(m, f"0{a + 1}{b:08}")


PLAIN = [
    *[(m, plain_card(m)) for m in ("4961143020124266", "4961 1430 2012 4266", "4961-1430 2012-4266", "378282246310005", "3782-822463-10005")],
    *[(m, plain_iban(m)) for m in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947")],
    *[(m, plain_date(m)) for m in ("1999-12-31", "2099-12-30", "1900-01-01", "2024-02-29")],
    *[(m, plain_ip(m)) for m in ("10.2.3.4", "255.255.255.255", "0.0.0.0")],
    *[(m, plain_ssn(m)) for m in ("123-45-6789", "899-99-9999", "665-01-0001", "667-01-0001")],
    *[(m, plain_mail(m)) for m in ("ab.12@x.org", "A@b.c.de", "long" * 40 + ".x@y.org")],
    *[(m, abroad(m, c)) for m, c in (("+33 1 42 68 53 00", "33"), ("+33 6 12 34 56 78", "33"), ("+353 1 234 5678", "353"), ("+7 495 123-45-67", "7"), ("+44 (0)20 7946 0958", "44"), ("0033 1 42 68 53 00", "33"), ("+4915112345678", "49"))],
    *[(m, poured(m, plain_ten(re.sub(r"\D", "", m)))) for m in ("(212) 555-0123", "212-555-0123", "142.155.0123", "(999)199-0000")],
    ("+1 (375) 555-4393", poured("+1 (375) 555-4393", "1" + plain_ten("3755554393"))),
    ("01 42 68 53 00", plain_french("01 42 68 53 00")),
]


def test_pseudonyms_are_those_of_plain_python(spark):
    rows = [(k, f"see {m}, and that") for k, (m, _) in enumerate(PLAIN)]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for k, (m, want) in enumerate(PLAIN):
        assert got[k].text == f"see {want}, and that", m
        assert got[k].n_private == (m != want)
    tail = pseudonymise(spark.createDataFrame([(0, "DE89 3704 0044 0532 0130 00 THIS STAYS"), (1, "+1 212 555 0123 15 apples")], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert tail[0].text == plain_iban("DE89 3704 0044 0532 0130 00") + " THIS STAYS"
    assert tail[1].text == "+1 " + poured("212 555 0123", plain_ten("2125550123")) + " 15 apples"


def test_what_fails_its_test_stays(spark):
    rows = ["4961143020124267", "10.2.3.400", "2024-02-30", "31.02.2020", "000-12-3456", "666-12-3456", "900-12-3456", "DE89370400440532013001", "+33 1", "12 34 56", "version 1.2.3", "a@b"]
    got = pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.text for r in got] == rows and not any(r.n_private for r in got)
    with pytest.raises(ValueError, match="key"):
        pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "")


def test_pseudonyms_in_very_long_and_odd_texts(spark, docs):
    odd = ["1" * 300000, "a@" + "b." * 100000, "a." * 100000 + "@x.org", "1234 " * 60000, "+1 " * 60000, "DE89 " + "ABCD " * 60000, "10." * 80000, "x" * 500000 + " 4961143020124266"]
    got = pseudonymise(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [len(r.text) for r in got] == [len(t) for t in odd] and got[-1].n_private == 1
    out = pseudonymise(docs.withColumn("n_private", F.lit("c")), KEY)
    assert set(out.columns) == {*docs.columns, "n_private"} and out.count() == docs.count()


def test_pseudonyms_are_one_to_one_and_keyed(spark):
    first = datetime.date(1990, 1, 1)
    days = [(k, str(first + datetime.timedelta(k))) for k in range(2000)]
    df = spark.createDataFrame(days, "doc_id long, text string")
    one, two = ([r.text for r in pseudonymise(df, k).orderBy("doc_id").collect()] for k in ("a", "b"))
    assert len(set(one)) == 2000 and one != two and all(datetime.date.fromisoformat(x) for x in one)


def test_language_model_is_a_probability_and_tells_languages_apart(spark):
    trees = Trees({"a": (__import__("numpy").array([0x61626364, 0x62636465]), __import__("numpy").array([3, 1])), "b": (__import__("numpy").array([0x61626365]), __import__("numpy").array([2]))})
    share = 2.0 ** -trees.bits.reshape(-1, trees.size, 2)
    share[:, 0] *= 256 - (trees.size - 1)
    assert abs(share.sum(axis=1) - 1).max() < 1e-4
    rows = [(k, ("the cat sat on the mat " if k % 2 else "der hund lag auf dem bett ") * 3, "en" if k % 2 else "de") for k in range(40)] + [(50, None, "en"), (51, "123 !", "en"), (52, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, df.where("doc_id < 20").select("lang", "text", F.xxhash64("doc_id").alias("pick"))).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") and 0.99 < got[k].score <= 1 for k in range(40))
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (50, 51, 52))


def test_held_out_language_accuracy(spark):
    from llm.queries import op7_language_id

    d = "/root/testdata/sf0.01"
    got = op7_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.select("doc_id", "held_out").collect())
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels")]


def test_quality_keeps_good_and_rejects_bad_it_has_not_seen(judged):
    docs, labels = judged
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    got = resample(docs, labels.where(fold != 0)).join(labels.where(fold == 0), "doc_id")
    share = {r.quality: r.s for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.15
    kept = resample(docs, labels)
    assert keep_sampled(docs, labels).select("doc_id").exceptAll(kept.where("kept").select("doc_id")).count() == 0
    assert resample(docs, labels, k=100).where("kept").count() == 100
    assert resample(docs, labels.where("quality = 1")).where("not kept").count() == 0


def test_sampling_is_a_draw_by_weight(judged):
    docs, labels = judged
    docs = docs.dropDuplicates(["doc_id"])
    one, two = (resample(docs, labels, k=300, seed=s).toPandas().set_index("doc_id").sort_index() for s in (1, 2))
    assert (one.log_weight == two.log_weight).all() and one.kept.sum() == two.kept.sum() == 300
    assert 60 < (one.kept & ~two.kept).sum() < 290  # another seed, another sample
    cut = one.log_weight.nlargest(300).min()
    assert 30 < (one.kept & (one.log_weight < cut)).sum()  # and none is a cut by weight
    rank = one.log_weight.rank(pct=True)
    share = [pd.concat([one.kept[rank.between(a, a + 0.25)], two.kept[rank.between(a, a + 0.25)]]).mean() for a in (0, 0.25, 0.5, 0.75)]
    assert share == sorted(share) and share[0] < 0.15 < share[3]


def test_registered_draw_follows_the_weight(judged):
    docs, labels = judged
    docs = docs.dropDuplicates(["doc_id"])
    got = [sample(docs, labels, seed=s).toPandas().set_index("doc_id").sort_index() for s in (1, 2, 3)]
    one, kept = got[0], sum(g.kept.astype(int) for g in got)
    assert all((g.accepted == one.accepted).all() and g.kept.sum() == int(SHARE * one.accepted.sum()) for g in got)
    assert not one.kept[~one.accepted].any() and one.gumbel_key.isna().eq(~one.accepted).all()
    good = one[one.accepted]
    cut = good.log_weight.nlargest(int(SHARE * len(good))).min()
    assert (good.kept & (good.log_weight < cut)).sum() > good.kept.sum() / 10  # no cut by weight
    assert (got[0].kept & ~got[1].kept).sum() > good.kept.sum() / 10  # another seed, another draw
    rank = good.log_weight.rank(pct=True)
    share = [kept[good.index][rank.between(a, a + 0.25)].mean() / 3 for a in (0, 0.25, 0.5, 0.75)]
    assert share == sorted(share) and share[0] < SHARE < share[3]


def test_draw_is_that_of_plain_python(spark, judged):
    docs, labels = judged
    got = sample(docs, labels, share=0.3, seed=5).toPandas()
    noise = docs.select("doc_id", gumbel(F.col("doc_id"), 5).alias("g")).distinct().toPandas().set_index("doc_id").g
    yes = got[got.accepted]
    key = (yes.log_weight / yes.log_weight.std(ddof=0) + noise[yes.doc_id].to_numpy()).round(5)
    last = key.nlargest(int(0.3 * len(yes))).min()
    assert (yes.kept[key > last].all()) and not yes.kept[key < last].any()


def test_weights_are_those_of_plain_counting(spark):
    from llm import importance as im

    texts = [(2**53 + 1, "a good plain text"), (2**53 + 3, "bad bad text"), (None, "a text"), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.log_weight for r in resample(docs, labels).collect()}
    one, two, at = im._ngrams([t for _, t in texts])
    grams = [[int(x) for x in [*one[a:b], *two[a:b]] if x >= 0] for a, b in zip(at[:-1], at[1:], strict=True)]
    count = lambda lists: {g: sum(x.count(g) for x in lists) for x in lists for g in x}
    target, raw = count(grams[:1]), count(grams)
    n_target, n_raw = sum(target.values()), sum(raw.values())
    for k, ((i, _), g) in enumerate(zip(texts, grams, strict=True)):
        own = 0 if k else 1  # the target's only text is weighed without itself
        ratio = sum(math.log((0 if own else target.get(x, 0)) + 1) - math.log((0 if own else n_target) + im.BUCKETS) - math.log((raw[x] + 1) / (n_raw + im.BUCKETS)) for x in g)
        assert abs(got[i] - im.TEMPER * ratio / (len(g) + im.PRIOR)) < 1e-5


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert resample(docs, labels).count() == sample(docs, labels).count() == docs.count()
    assert sample(docs, labels.where("quality = 0")).where("not accepted").count() == 0
    assert set(keep_sampled(docs, labels).columns) == set(docs.columns)


def test_kth_highest_is_exact(spark):
    df = spark.range(1000).select((F.pmod(F.xxhash64("id"), F.lit(300)).cast("double") / 7).alias("x"))
    want = sorted((r.x for r in df.collect()), reverse=True)
    assert [kth_highest(df, "x", k) for k in (1, 17, 500, 999)] == [want[k - 1] for k in (1, 17, 500, 999)]
    assert kth_highest(df, "x", 1000) is None


def test_threshold():
    import numpy as np

    one = lambda *x: np.array(x, float)
    assert -5 < threshold(one(1, 2, 3), one(1, 1, 1), one(-5, -6), one(1, 1), 0.0) < 1
