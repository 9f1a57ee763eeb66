"""Text expressions: tokens, keywords, sentences, rule-based labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"


def tokens(text: Column) -> Column:
    """Each CJK character, then each word of the lower-cased text; repeats stay."""
    low = F.lower(text)
    chars = F.when(low.rlike(f"[{CJK}]"), F.regexp_extract_all(low, F.lit(f"[{CJK}]"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.split(low, r"[^\p{L}\p{N}\p{M}_]+"), lambda x: x != "")
    return F.when(text.isNotNull(), F.concat(chars, found))


def words(text: Column, stop: list[str]) -> Column:
    """Words of two characters or more that are no stop words."""
    return F.filter(tokens(text), lambda x: (F.length(x) >= 2) & ~x.isin(stop))


def sentences(text: Column, longer_than: int = 5, cut: int = 200) -> Column:
    parts = F.split(text, "[。！？\\n]+")
    return F.transform(F.filter(F.transform(parts, F.trim), lambda x: F.length(x) > longer_than), lambda x: F.substring(x, 1, cut))


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of characters; 0 when both are empty."""
    split = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda x: x != ""))
    union = F.size(F.array_union(split(a), split(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(split(a), split(b))) / union)


def first_label(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The label of the first rule any of whose words the text contains."""
    out = F.lit(default)
    for names, label in reversed(rules):
        out = F.when(contains_any(text, names), label).otherwise(out)
    return out


def contains_any(text: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in names])


def count_of(text: Column, names: list[str]) -> Column:
    """How many of the names the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in names])


def read_only(query: str) -> bool:
    """Whether a SQL text only reads: it starts as a query and no forbidden word stands outside its quotes."""
    import re

    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", query, flags=re.DOTALL).strip()
    if ";" in bare.rstrip(";") or not re.match(r"(select|with|from|values)\b", bare, re.IGNORECASE):
        return False
    return not re.search(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|set|call|load|refresh|cache|grant|revoke)\b", bare, re.IGNORECASE)
