"""Text of office documents: ZIP archives of XML, read with the standard library inside mapInPandas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame


def _name(node) -> str:
    return node.tag.rpartition("}")[2]


def _all(node, name: str) -> list:
    return [x for x in node.iter() if _name(x) == name]


def _text(node) -> str:
    return "".join(x.text or "" for x in _all(node, "t"))


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    """The archive's members of a numbered kind, by number."""
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def word_parts(archive: zipfile.ZipFile) -> list[str]:
    """One part: the paragraphs that aren't blank, a line each."""
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = [x for p in _all(root, "p") if (x := _text(p)).strip()]
    return ["\n".join(lines)] if lines else []


def slide_parts(archive: zipfile.ZipFile) -> list[str]:
    """A part for each slide with text; a table's row is one line, its cells parted by bars."""
    out = []
    for name in _numbered(archive, r"ppt/slides/slide(\d+)\.xml"):
        root, lines = ElementTree.fromstring(archive.read(name)), []

        def walk(node) -> None:
            if _name(node) == "tr":
                lines.append(" | ".join(_text(c).strip() for c in node if _name(c) == "tc"))  # noqa: B023
            elif _name(node) == "p":
                lines.append(_text(node).strip())  # noqa: B023
            else:
                for child in node:
                    walk(child)

        walk(root)
        if kept := [x for x in lines if x.strip(" |")]:
            out.append("\n".join(kept))
    return out


def sheet_parts(archive: zipfile.ZipFile) -> list[str]:
    """A part for each sheet with cells: its number of rows and columns, then every row, cells parted by bars."""
    shared = [_text(x) for x in _all(ElementTree.fromstring(archive.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in archive.namelist() else []

    def shown(cell) -> str:
        value = next((v.text or "" for v in cell if _name(v) == "v"), "")
        return _text(cell) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value

    out = []
    for name in _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"):
        rows = []
        for row in _all(ElementTree.fromstring(archive.read(name)), "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(x for x in row if _name(x) == "c"):
                at = 0
                for letter in re.sub("[^A-Z]", "", c.get("r", "")):
                    at = at * 26 + ord(letter) - 64
                cells[at - 1 if at else k] = shown(c)
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        if rows:
            out.append("\n".join([f"{len(rows)} rows, {max(map(len, rows))} columns", *(" | ".join(r) for r in rows)]))
    return out


_PARTS = {"docx": word_parts, "pptx": slide_parts, "xlsx": sheet_parts}


def opened(kind: str, content: bytes) -> list[str]:
    """The parts of one file; an error (ValueError) where it isn't a whole archive of its kind."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return _PARTS[kind](archive)
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as x:
        raise ValueError(f"no {kind} file") from x


def office_parts(kind: str | None, content: bytes | None) -> list[str]:
    """The parts of one file; none for other kinds, nulls and what isn't a whole archive of its kind."""
    try:
        return opened(kind, content) if kind in _PARTS and content is not None else []
    except ValueError:
        return []


def office_texts(files: DataFrame) -> DataFrame:
    """path, part (from 0) and content of files (path, kind, content), as ``parsers.files`` lists them."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, x) for p, kind, c in zip(b["path"], b["kind"], b["content"], strict=True) for k, x in enumerate(office_parts(kind, c))]
            yield pd.DataFrame(rows, columns=["path", "part", "content"])

    return files.select("path", "kind", "content").mapInPandas(parse, "path string, part int, content string")
