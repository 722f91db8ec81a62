"""Front ends: source text to relations. One task parses one file at a time; files spread over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...schemas import PARSED, RELATIONS
from . import braces, python


def parse_text(text: str, path: str, language: str) -> dict[str, list[dict]]:
    """The relations of one file; what cannot be parsed has none."""
    try:
        return python.parse(text, path) if language == "python" else braces.parse(text, path, language)
    except (SyntaxError, ValueError, RecursionError):
        return {k: [] for k in RELATIONS}


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        made = [{"file": r.file, "language": r.language} | parse_text(r.content, r.file, r.language) for r in part.itertuples()]
        yield pd.DataFrame(made, columns=["file", "language", *RELATIONS])


def parse(files: DataFrame) -> DataFrame:
    """(file, language, content) to one row a file with an array for each relation."""
    return files.select("file", "language", "content").mapInPandas(_rows, PARSED)


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """One of the relations, a row each."""
    return parsed.select(F.inline(name))
