"""Operator 1: format-preserving Feistel pseudonyms for personal data.

Numbers and dates that pass their format's own test, phone numbers and the local
parts of e-mail addresses are replaced by a keyed permutation within the same
format. A Feistel network of ``ROUNDS`` rounds over the two halves of the value
does it, with SHA-256 as round function, so the same value gets the same
pseudonym in every document, whatever separators it is written with, and two
values of a format never share one. Check digits are computed anew. Only
DataFrame functions are used.

What is found, and the test it must pass:

* cards: 13 to 19 digits in one run, or in groups of 4-4-4-(1 to 7) or 4-6-5 with
  spaces and hyphens in any mixture; Luhn
* IBANs of upper-case letters, solid or in groups of four; country's length, mod 97
* IPv4 addresses; four numbers below 256
* nine-digit social security numbers written 3-2-4; the ranges of areas, groups, serials
* dates of 1900 to 2099 as Y-M-D, Y/M/D, D.M.Y, M/D/Y or else D/M/Y; the calendar
* phone numbers: + or 00 (then a separator after the country code) and 7 to 15
  digits, groups of any size with spaces, dots, hyphens and round brackets, the
  country code staying as it is; ten-digit North American ones with separators,
  the first digits of area and exchange staying 2 to 9 or 0 to 1; French ones
  written as five pairs
* e-mail addresses, local parts of any length; the domain stays

Not found: other national phone numbers, dates with names of months, names,
postal addresses, IPv6 addresses, lower-case IBANs, other identity numbers.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Even, so that halves of different lengths are back in place at the end.
ROUNDS = 8
#: The session's setting with the secret key.
KEY = "spark.llm.pseudonymKey"

#: Repeated groups are bounded, as Java's matcher recurses into groups and very long texts would exhaust its stack; runs of single characters need no bound.
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,9}[A-Za-z]{2,63}"
CARD = rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_E}"
_NANP = r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
_FRENCH = r"0[1-9](?:[ .-][0-9]{2}){4}"
_ABROAD = r"(?:\+[1-9]|00[1-9][0-9]{0,2}[ .-]\(?[0-9])(?:\)?[ .-]?\(?[0-9]){6,14}"
PHONE = rf"(?<![0-9A-Za-z+])(?:{_ABROAD}|{_NANP}|{_FRENCH}){_E}"
SSN = rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])"
IBAN = rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}"
DATE = rf"{_B}(?:(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|(?:19|20)[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}[./](?:[0-9]{{2}})[./](?:19|20)[0-9]{{2}}){_E}"
ANY = "|".join((CARD, EMAIL, DATE, IP, SSN, PHONE, IBAN))
#: Country codes of one and two digits; all others have three.
_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Lengths of IBANs (fixed values of the standard); for other countries, whatever was matched.
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
#: Characters of an e-mail's local part that are permuted together.
_BLOCK = 64

_DAYS = 73_000  # of 250 x 292, from 1900-01-01 on; the 49 days that 2099 has left are 7 x 7
_FIRST = "1900-01-01"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hex(key: str, tag: str | Column, round_: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tag if isinstance(tag, Column) else F.lit(tag), round_.cast("string"), value), 256)


def _number(hex_: Column, at: int = 1) -> Column:
    return F.conv(F.substring(hex_, at, 12), 16, 10).cast("long")


def _shift(half: Column, stream: Column) -> Column:
    """Each letter and digit moved on within its own kind by two digits of the stream."""

    def one(i: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        k = F.conv(F.substr(stream, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda first, n: F.char(F.ascii(F.lit(first)) + F.pmod(F.ascii(c) - F.ascii(F.lit(first)) + k, F.lit(n)))
        return F.when(c.between("0", "9"), move("0", 10)).when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), "")


def feistel_text(value: Column, key: str, tag: str) -> Column:
    """A permutation of the strings that have ``value``'s kind of character at each place."""
    return _let(value, lambda v: _feistel_text(v, key, tag))


def _feistel_text(value: Column, key: str, tag: str | Column) -> Column:
    at = (F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), at).alias("a"), F.substr(value, at + 1, F.length(value)).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    end = F.aggregate(rounds, start, lambda s, r: F.struct(s["b"].alias("a"), _let(_hex(key, tag, r, s["b"]), lambda h: _shift(s["a"], h)).alias("b")))
    return _let(end, lambda x: F.concat(x["a"], x["b"]))


def feistel_pair(a: Column, b: Column, n_a: Column, n_b: Column, key: str, tag: str) -> Column:
    """A permutation of the pairs of 0..n_a - 1 and 0..n_b - 1, as struct a, b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        a2 = F.when(odd, F.pmod(s["a"] + _number(_hex(key, tag, r, s["b"].cast("string"))), n_a)).otherwise(s["a"])
        b2 = F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + _number(_hex(key, tag, r, s["a"].cast("string"))), n_b))
        return F.struct(a2.alias("a"), b2.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))


def luhn_sum(digits: Column) -> Column:
    """The sum of Luhn's test; a valid number's ends in 0."""
    return _let(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = (n - i) % 2 == 1
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _mod97(s: Column) -> Column:
    """Of an IBAN with its first four characters at the end, letters as 10 to 35."""

    def add(total: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (total * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(_chars(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))), F.lit(0), add)


def _pour(layout: Column, filling: Column, kind: str) -> Column:
    """``layout`` with the characters of its class ``kind`` replaced in turn by those of ``filling``."""
    return _let(F.struct(layout.alias("layout"), filling.alias("filling")), lambda x: _poured(x["layout"], x["filling"], kind))


def _poured(layout: Column, filling: Column, kind: str) -> Column:
    def one(i: Column) -> Column:
        c = F.substr(layout, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substr(layout, F.lit(1), i), f"[^{kind}]", ""))
        return F.when(c.rlike(f"[{kind}]"), F.substr(filling, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), one), "")


def _date(m: Column, key: str) -> Column:
    """The pseudonym of a date, null if the calendar doesn't have it."""
    iso = m.rlike("^[0-9]{4}-")
    ymd = m.rlike("^[0-9]{4}/")
    dotted = m.contains(".")
    read = lambda f: F.to_date(F.try_to_timestamp(m, F.lit(f)))
    us = read("MM/dd/yyyy")
    day_ = F.when(iso, read("yyyy-MM-dd")).when(ymd, read("yyyy/MM/dd")).when(dotted, read("dd.MM.yyyy")).otherwise(F.coalesce(us, read("dd/MM/yyyy")))
    return _let(day_, lambda day: _moved(m, day, iso, ymd, dotted, us, key))


def _moved(m: Column, day: Column, iso: Column, ymd: Column, dotted: Column, us: Column, key: str) -> Column:
    n = F.datediff(day, F.lit(_FIRST).cast("date"))
    tail = n >= _DAYS
    size_b = F.when(tail, 7).otherwise(292).cast("long")
    n0 = F.when(tail, n - _DAYS).otherwise(n).cast("long")
    out = feistel_pair(F.floor(n0 / size_b), n0 % size_b, F.when(tail, 7).otherwise(250).cast("long"), size_b, key, "date")
    moved = _let(out, lambda x: F.date_add(F.lit(_FIRST).cast("date"), (x["a"] * size_b + x["b"] + F.when(tail, _DAYS).otherwise(0)).cast("int")))
    shown = lambda new: F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(ymd, F.date_format(new, "yyyy/MM/dd")).when(dotted, F.date_format(new, "dd.MM.yyyy")).when(us.isNotNull(), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return F.when(day.isNotNull() & (n >= 0), _let(moved, shown))


def _local(value: Column, key: str) -> Column:
    """A local part, block by block; each block's permutation knows its number."""
    blocks = F.regexp_extract_all(value, F.lit(f".{{1,{_BLOCK}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, lambda x, i: _feistel_text(x, key, F.concat(F.lit("email"), i.cast("string")))), "")


def _north_american(national: Column, key: str) -> Column:
    """Ten digits. Area and exchange whose first digit is 2 to 9 keep such a one, and so do those of 0 and 1."""
    area, rest = F.substring(national, 1, 3).cast("long"), F.substring(national, 4, 7).cast("long")
    low_a, low_b = F.when(area < 200, 0).otherwise(200).cast("long"), F.when(rest < 2_000_000, 0).otherwise(2_000_000).cast("long")
    n_a, n_b = F.when(area < 200, 200).otherwise(800).cast("long"), F.when(rest < 2_000_000, 2_000_000).otherwise(8_000_000).cast("long")
    pair = feistel_pair(area - low_a, rest - low_b, n_a, n_b, key, "nanp")
    return _let(pair, lambda x: F.concat(F.lpad((x["a"] + low_a).cast("string"), 3, "0"), F.lpad((x["b"] + low_b).cast("string"), 7, "0")))


def _phone(m: Column, digits: Column, key: str) -> Column:
    zeros = F.when(m.startswith("00"), F.lit(2)).otherwise(F.lit(0))
    abroad = m.startswith("+") | (zeros > 0)
    number = F.substr(digits, zeros + 1, F.length(digits))
    code = F.when(abroad, F.regexp_extract(number, _CODE, 0)).otherwise("")
    national = F.substr(number, F.length(code) + 1, F.length(number))
    # of what follows a North American number, nothing belongs to it
    american = (code == "1") & (F.length(national) >= 10) | ~abroad & (F.length(number) == 10) & ~m.rlike(f"^{_FRENCH}$")
    ten, more = F.substring(national, 1, 10), F.substr(national, F.lit(11), F.length(national))
    # a French number is 0, one of 1 to 9 and eight digits
    french = feistel_pair(F.substring(national, 2, 1).cast("long") - 1, F.substring(national, 3, 8).cast("long"), F.lit(9).cast("long"), F.lit(100_000_000).cast("long"), key, "french")
    french = _let(french, lambda x: F.concat(F.lit("0"), (x["a"] + 1).cast("string"), F.lpad(x["b"].cast("string"), 8, "0")))
    new = F.when(american, F.concat(_north_american(ten, key), more)).when(~abroad, french).otherwise(_feistel_text(national, key, F.concat(F.lit("phone"), code)))
    return F.when(F.length(number).between(7, 15) & (F.length(national) > 1), _pour(m, F.concat(F.substr(digits, F.lit(1), zeros), code, new), "0-9")).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    solid = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(solid, 1, 2)
    known = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS for x in (c[:2], int(c[2:]))])
    n = F.coalesce(F.try_element_at(known, country), F.length(solid))
    value = F.substr(solid, F.lit(1), n)
    bban = feistel_text(F.substr(value, F.lit(5), n), key, "iban")
    check = lambda x: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0")
    new = _let(bban, lambda x: F.concat(country, check(x), x))
    return F.when((F.length(solid) >= n) & (_mod97(value) == 1), _pour(m, F.concat(new, F.substr(solid, n + 1, F.length(solid))), "A-Z0-9")).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; a match that fails its format's test is returned as it is."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new_body = feistel_text(body, key, "card")
    card = _pour(m, _let(new_body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))), "0-9")
    local = F.substring_index(m, "@", 1)
    email = F.concat(_local(local, key), F.substr(m, F.length(local) + 1, F.length(m)))
    ip_ = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))
    ip_new = feistel_pair(ip_[0] * 256 + ip_[1], ip_[2] * 256 + ip_[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    ip = _let(ip_new, lambda x: F.concat_ws(".", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256))
    # 9-digit numbers: area 1-665 and 667-899 (898 of them) x group 1-99, and serial 1-9999
    area = F.substring(m, 1, 3).cast("int")
    group, serial = F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    pair = feistel_pair((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")

    def written(s: Column) -> Column:
        new_area = F.floor(s["a"] / 99) + 1
        return F.concat_ws("-", F.lpad((new_area + F.when(new_area > 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    ssn = _let(pair, written)
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), email)
        .when(whole(CARD), F.when(luhn_sum(digits) % 10 == 0, card).otherwise(m))
        .when(whole(DATE), F.coalesce(_date(m, key), m))
        .when(whole(IP), F.when(F.forall(ip_, lambda x: x < 256), ip).otherwise(m))
        .when(whole(SSN), F.when(~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0), ssn).otherwise(m))
        .when(whole(PHONE), _phone(m, digits, key))
        .when(whole(IBAN), _iban(m, key))
        .otherwise(m)
    )


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting ``KEY`` names. Without it, a new random one that is kept in the setting, so that equal values stay linked as long as the session lives; name one to link them for longer."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the column ``text`` pseudonymised and n_private (int) added: how many values were replaced.

    ``key`` is secret: who has it can undo the permutation. It is part of the
    plan, which Spark's event logs may show. A text without such values, an empty
    and a null one stay as they are (null counts 0). Nothing is shuffled;
    repeated rows stay repeated; an existing column n_private is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    held = docs.withColumn("__pii_found", F.when(F.col(text).rlike("[0-9@]"), found))
    held = held.withColumn("__pii_new", F.when(F.size("__pii_found") > 0, F.transform("__pii_found", lambda m: pseudonym(m, key))))
    gaps = F.split(F.col(text), ANY, -1)
    woven = F.zip_with(gaps, F.concat(F.col("__pii_new"), F.array(F.lit(""))), lambda g, n: F.concat(g, n))
    changed = F.size(F.filter(F.zip_with("__pii_found", "__pii_new", lambda a, b: a != b), lambda x: x))
    held = held.withColumn("n_private", F.when(F.col("__pii_new").isNull(), 0).otherwise(changed)).withColumn(text, F.when(F.col("__pii_new").isNull(), F.col(text)).otherwise(F.array_join(woven, "")))
    return held.drop("__pii_found", "__pii_new")
