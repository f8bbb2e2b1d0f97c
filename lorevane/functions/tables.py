"""Table functions for SQL: links and cells of markup, and the dense grid of a table with spans.

    register(spark)
    SELECT page_id, l.* FROM pages, LATERAL html_links(html) AS l
    SELECT page_id, c.* FROM pages, LATERAL html_cells(html, 'AutoNumber1') AS c
    SELECT * FROM expand_spans(TABLE(cells) PARTITION BY table_id ORDER BY (r, ord))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _asked(argument: AnalyzeArgument | None, default: str | None, name: str) -> str | None:
    """The value of a constant text argument."""
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _text(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} must be a text, not {argument.dataType.simpleString()}")


@F.udtf
class HtmlLinks:
    """ord, href, txt, tr_text of every link of a page: its text, and that of the table row around it."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _text(html, "html")
        return AnalyzeResult(StructType().add("ord", IntegerType()).add("href", StringType()).add("txt", StringType()).add("tr_text", StringType()))

    def eval(self, html: str | None) -> Iterator[tuple]:
        from ..operators.html_links import links_of

        for i, (href, text, row) in enumerate(links_of(html or "")):
            yield i, href, text, row


@F.udtf
class HtmlCells:
    """r, ord, rowspan, colspan, text of every cell of a page's tables, or of those with one id."""

    @staticmethod
    def analyze(html: AnalyzeArgument, table_id: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(html, "html")
        kinds = StructType()
        for name in ("r", "ord", "rowspan", "colspan"):
            kinds = kinds.add(name, IntegerType())
        return AnalyzeResult(kinds.add("text", StringType()))

    def eval(self, html: str | None, table_id: str | None = None) -> Iterator[tuple]:
        from ..operators.html_links import cells_of

        yield from cells_of(html or "", table_id)


@F.udtf
class ExpandSpans:
    """key, row, col, text: the dense grid of each table of cells(key, r, ord, rowspan, colspan, text).

    The table argument is partitioned by the key, which has the key's type in the result, and ordered by r and ord. A task
    holds one table at a time.
    """

    @staticmethod
    def analyze(cells: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = _asked(key, "table_id", "key")
        if not cells.isTable:
            raise ValueError("cells must be a TABLE(...) argument")
        kinds = {f.name: f.dataType for f in cells.dataType.fields}
        missing = [c for c in (name, "r", "ord", "rowspan", "colspan", "text") if c not in kinds]
        if missing:
            raise ValueError(f"cells lacks {', '.join(missing)}")
        return AnalyzeResult(StructType().add(name, kinds[name]).add("row", LongType()).add("col", LongType()).add("text", StringType()))

    def __init__(self) -> None:
        self.cells: list[tuple] = []
        self.key = None

    def eval(self, cells: Row, key: str = "table_id") -> None:
        self.key = cells[key]
        self.cells.append((cells["r"], cells["ord"], cells["rowspan"], cells["colspan"], cells["text"]))

    def terminate(self) -> Iterator[tuple]:
        from ..operators.grids import spread

        for (r, c), text in spread(self.cells).items():
            yield self.key, r, c, text


FUNCTIONS = {"html_links": HtmlLinks, "html_cells": HtmlCells, "expand_spans": ExpandSpans}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL in this session."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
