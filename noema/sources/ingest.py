"""Files of many kinds turned into chunks of text, each kind by its own parser."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.functions.rules import language
from noema.sources import code, office, parsers

_KINDS = {"html": "web", "htm": "web", "docx": "word", "pptx": "ppt", "xlsx": "table", "csv": "table", "ipynb": "notebook", "txt": "text", "md": "text"}
#: Confidence of what a parser of its own has read, and of what was only taken as text.
SURE, UNSURE = 1.0, 0.3
#: Rows of a table that are set out together.
ROWS = 100


def kind_of(path: F.Column) -> F.Column:
    """web, word, ppt, table, notebook, text, code or other, by the ending."""
    known = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.coalesce(F.try_element_at(known, ending), F.when(language(path).isin("python", "javascript", "typescript", "java", "go", "rust", "cpp", "c", "csharp"), "code"), F.lit("other"))


def table_text(df: pd.DataFrame) -> str:
    """Size, types and every row of a table; columns are as wide as ``ROWS`` rows need, so that one long cell doesn't fill up all others."""
    blocks = [df.iloc[k : k + ROWS].to_string(header=k == 0) for k in range(0, max(len(df), 1), ROWS)]
    return "\n".join([f"{len(df)} rows, {len(df.columns)} columns", ", ".join(f"{c} {t}" for c, t in df.dtypes.items()), *blocks])


def parsed(path: str, kind: str, content: bytes) -> list[tuple[str, str, float]]:
    """(kind, text, confidence) of each chunk of a file; a file that its parser can't read is taken as text, with little confidence."""
    text = content.decode("utf-8", "ignore")
    try:
        if kind == "web":
            found = parsers.page_text(text, 1, False, parsers.FILE_DROPPED)
            return [(kind, found, SURE)] if found else []
        if kind == "table" and path.lower().endswith("csv"):
            return [(kind, table_text(pd.read_csv(io.BytesIO(content))), SURE)]
        if kind in ("word", "ppt", "table"):
            return [(kind, x, SURE) for x in office.opened(path.rpartition(".")[2].lower(), content)]
        if kind == "notebook":
            cells = ["".join(c["source"]) for c in json.loads(text)["cells"] if c.get("cell_type") == "code"]
            return [(kind, "\n\n".join(c for c in cells if c.strip()), SURE)]
        if kind == "code" and path.endswith(".py"):
            return [(k, x, SURE) for k, x in code.chunks(path.rpartition("/")[2], text)]
        if kind in ("code", "text"):
            return [(kind, text, SURE)]
    except (ValueError, KeyError, TypeError):
        pass
    return [("other", text, UNSURE)]


def parsed_files(files: DataFrame) -> DataFrame:
    """path, part (from 0), kind, text and confidence of files (path, content); a file is one row of a task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, *x) for p, k, c in zip(b["path"], b["kind"], b["content"], strict=True) for n, x in enumerate(parsed(p, k, bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "part", "kind", "text", "confidence"])

    return files.select("path", kind_of(F.col("path")).alias("kind"), "content").mapInPandas(parse, "path string, part int, kind string, text string, confidence double")


def chunks(spark: SparkSession, path: str, max_mb: int = 1024) -> DataFrame:
    """``parsed_files`` of every file under the path that isn't larger than ``max_mb``."""
    return parsed_files(parsers.files(spark, path, max_mb))
