"""Rows of HTML tables and lists, as a table function over pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Rows(HTMLParser):
    """Cells of the rows of tables, or of one table by its id; a list item is a row of one cell."""

    def __init__(self, table_id: str | None) -> None:
        super().__init__()
        self.table_id, self.depth, self.take = table_id, 0, table_id is None
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
            if self.table_id is not None and dict(attrs).get("id") == self.table_id:
                self.take = True
        elif not self.take:
            return
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th", "li"):
            if tag == "li" or not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "li") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table":
            self.depth -= 1
            if self.table_id is not None and self.depth == 0:
                self.take = False


def table_rows(pages: DataFrame, table_id: str | None = None) -> DataFrame:
    """(page_id, row_no, cells) of every page; pages: (page_id, html)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, html in b[["page_id", "html"]].itertuples(index=False):
                parser = _Rows(table_id)
                parser.feed(html or "")
                out += [(page_id, i, cells) for i, cells in enumerate(r for r in parser.rows if r)]
            yield pd.DataFrame(out, columns=["page_id", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, row_no long, cells array<string>")
