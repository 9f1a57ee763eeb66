"""Parsers of pages, notebooks, code and tables, as DataFrame functions or mapInPandas."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators.blocks import spread

# Tags whose text is no content, of a page from the web and of one from a file.
_DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
FILE_DROPPED = ("script", "style", "nav", "footer", "header")


#: Files whose functions a task holds at a time.
FILES = 1024

_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TITLE = "页面标题: "


class _Lines(HTMLParser):
    """The texts outside dropped tags; the end of an outer tag ends what stands open inside it."""

    def __init__(self, dropped):
        super().__init__()
        self.dropped, self.open, self.deep, self.title, self.lines = dropped, [], 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
            self.deep += tag in self.dropped

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.deep -= last in self.dropped
                if last == tag:
                    break

    def handle_data(self, data):
        if "title" in self.open:
            self.title = (self.title or "") + data
        if not self.deep:
            self.lines += [x.strip() for x in data.splitlines()]


def page_text(html: str, shortest: int = 3, with_title: bool = True, dropped=_DROPPED, known: dict[str, str] | None = None) -> str | None:
    """Text lines of at least ``shortest`` characters, the title's own among them, below a line with the title where there is one; None when there is neither.

    With ``known`` (names and their characters) only ``&amp;`` and those
    references stand for characters, ended by a semicolon; in the line with the
    title only ``&amp;``. A reference that a page's end cuts off stays as it is.
    """
    p = _Lines(dropped)
    html = html or ""
    # a private character stands for each of the known ones meanwhile
    marks = {name: m for name, m in zip(known or {}, (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in html))}  # noqa: B905
    if known is not None:
        html = re.sub("&(?!amp;)", "&amp;", reduce(lambda t, n: t.replace(f"&{n};", marks[n]), marks, html))
    p.feed(html)
    p.close()
    shown = lambda t: reduce(lambda t, n: t.replace(marks[n], known[n]), marks, t)
    lines = [shown(x) for x in p.lines if len(x) >= shortest]
    title = reduce(lambda t, n: t.replace(marks[n], f"&{n};"), marks, p.title or "").strip() if with_title else ""
    return f"{TITLE}{title}\n\n" + "\n".join(lines) if title else "\n".join(lines) or None


def pages(rows: DataFrame, shortest: int = 3, with_title: bool = True, known: dict[str, str] | None = None) -> DataFrame:
    """page_id and content of rows (page_id, html); pages without text have no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(content=[page_text(h, shortest, with_title, known=known) for h in b["html"]])
            yield b.loc[b["content"].notna(), ["page_id", "content"]]

    return rows.select("page_id", "html").mapInPandas(parse, "page_id long, content string")


def python_facts(code: str) -> list[dict]:
    """Functions of a module: name, arguments, calls, branches + 1; nothing for code that doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    out = []
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
            branches = sum(isinstance(x, ast.If | ast.For | ast.While | ast.ExceptHandler | ast.IfExp | ast.comprehension | ast.BoolOp | ast.Assert) for x in ast.walk(f))
            out.append({"name": f.name, "args": [a.arg for a in f.args.args], "calls": calls, "complexity": branches + 1})
    return out


def code_functions(files: DataFrame) -> DataFrame:
    """path, name, args, calls, complexity of the functions of files (path, code)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for few in (b.iloc[k : k + FILES] for b in batches for k in range(0, len(b), FILES)):
            yield pd.DataFrame([{"path": p, **f} for p, c in zip(few["path"], few["code"], strict=True) for f in python_facts(c)], columns=["path", "name", "args", "calls", "complexity"])

    return spread(files, "path").mapInPandas(parse, "path string, name string, args array<string>, calls array<string>, complexity int")


def notebook_code(rows: DataFrame, col: str = "content") -> DataFrame:
    """The non-empty code cells of notebooks (JSON), on end."""
    cells = F.from_json(col, "cells array<struct<cell_type:string,source:array<string>>>")["cells"]
    code = F.filter(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.array_join(c["source"], "")), lambda s: F.trim(s) != "")
    return rows.withColumn("code", F.array_join(code, "\n\n"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row: path and content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def files(spark: SparkSession, path: str, max_mb: int = 1024) -> DataFrame:
    """Files up to a size, with their kind by extension."""
    kind = F.lower(F.substring_index("path", ".", -1))
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= max_mb * 1024 * 1024).withColumn("kind", kind)


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and columns of a table, and its columns' types."""
    n = df.agg(F.count("*").alias("rows"))
    return n.select("rows", F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(f"{c}: {t}" for c, t in df.dtypes)).alias("types"))
