"""Facts of source files, as edges: Python by its own parser, other languages line by line."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from noema.operators.blocks import spread

#: Files whose edges a task holds at a time.
FILES = 128

# How a line of each language begins that defines a function, and one that imports.
_HEADER = r"^(?:public|private|protected|static)?\s*(?:async\s+)?(?:[\w<>\[\],\s]+)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+\s*)?\{\s*$"
_FUNCTION = {
    **dict.fromkeys(("javascript", "typescript"), r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    **dict.fromkeys(("java", "cpp", "csharp", "kotlin"), _HEADER),
    "rust": r"^(?:pub\s+)?fn\s+(\w+)",
    "go": r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)",
}
_NO_FUNCTION = {"if", "for", "while", "switch", "catch", "with"}
_FROM = r"""import\s+(?:\{[^}]+\}|\w+)\s+from\s+['"]([^'"]+)['"]"""
_IMPORT = {
    "javascript": [_FROM, r"""const\s+(?:\{[^}]+\}|\w+)\s*=\s*require\s*\(['"]([^'"]+)['"]\)""", r"""import\s+['"]([^'"]+)['"]"""],
    "typescript": [_FROM],
    "go": [r"""import\s+['"]([^'"]+)['"]"""],
    "rust": [r"use\s+([\w:]+)"],
}
_SAYS = re.compile(r"(Algorithm|Concept): *([^.;\n]+)")


def _called(node: ast.AST) -> list[str]:
    names = [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)]
    return sorted(set(names))


def python_edges(path: str, code: str) -> list[tuple[str, str, str]]:
    """(src, dst, kind) of a module: what it imports and defines, what classes hold and stand for, what functions call, and the algorithms and concepts that their docstrings name. Nothing for code that doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, imports = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(node.module or ".")
    out += [(path, m, "IMPORTS") for m in sorted(set(imports))]
    inside = set()
    for c in (n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)):
        out.append((path, c.name, "DEFINES_CLASS"))
        out += [(c.name, b.id, "IS_A") for b in c.bases if isinstance(b, ast.Name)]
        for f in c.body:
            if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                inside.add(f)
                out.append((c.name, f.name, "DEFINES_FUNCTION"))
    for f in (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)):
        if f not in inside:
            out.append((path, f.name, "DEFINES_FUNCTION"))
        out += [(f.name, x, "CALLS") for x in _called(f)]
        out += [(f.name, name.strip(), "IMPLEMENTS_ALGORITHM" if kind == "Algorithm" else "RELATED_TO_CONCEPT") for kind, name in _SAYS.findall(ast.get_docstring(f) or "")]
    return out


def line_edges(path: str, code: str, language: str) -> list[tuple[str, str, str]]:
    """(src, dst, kind) of a file of another language: functions and imports by how lines begin."""
    out = []
    for line in (x.strip() for x in code.split("\n")):
        m = re.match(_FUNCTION[language], line) if language in _FUNCTION else None
        if m and m[1] not in _NO_FUNCTION:
            out.append((path, m[1], "DEFINES_FUNCTION"))
        for pattern in _IMPORT.get(language, []):
            if m := re.match(pattern, line):
                out.append((path, m[1], "IMPORTS"))
                break
    return out


def code_edges(files: DataFrame) -> DataFrame:
    """Edges src, dst, kind and file of files (path, language, code), all rows as they are found; a file is one row of a task, which gives the edges of a few files at a time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for few in (b.iloc[k : k + FILES] for b in batches for k in range(0, len(b), FILES)):
            rows = [(*e, p) for p, lang, c in zip(few["path"], few["language"], few["code"], strict=True) for e in (python_edges(p, c) if lang == "python" else line_edges(p, c, lang))]
            yield pd.DataFrame(rows, columns=["src", "dst", "kind", "file"])

    return spread(files.select("path", "language", "code"), "path").mapInPandas(parse, "src string, dst string, kind string, file string")


def chunks(path: str, code: str) -> list[tuple[str, str]]:
    """(kind, text) of a Python file: an overview, then each function and each class with its source."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return [("code", code)]
    named = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    functions, classes = [n for n in named if not isinstance(n, ast.ClassDef)], [n for n in named if isinstance(n, ast.ClassDef)]
    overview = f"{path}: {code.count(chr(10)) + 1} lines, {len(functions)} functions, {len(classes)} classes"
    return [("overview", overview), *[("function", ast.get_source_segment(code, f)) for f in functions], *[("class", ast.get_source_segment(code, c)) for c in classes]]
