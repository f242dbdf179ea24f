"""Tables and lists of HTML pages as rows, by a streaming parser in a Python table function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TableParser(HTMLParser):
    """Rows of the outermost tables, as lists of cell texts; what nests inside a cell's table is dropped.

    Malformed markup: a cell outside a row is ignored, a cell or row that is still open when the next one opens is
    lost, an open cell is kept at its row's or table's end, a closed row without cells is an empty list, and a table
    that is never closed gives nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self._depth = 0
        self._rows: list[list[str]] = []
        self._row: list[str] | None = None
        self._cell: list[str] | None = None

    def _keep_cell(self) -> None:
        if self._cell is not None:
            self._row.append(" ".join("".join(self._cell).split()))
        self._cell = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self._depth += 1
            if self._depth == 1:
                self._rows, self._row, self._cell = [], None, None
        elif self._depth == 1:
            if tag == "tr":
                self._row, self._cell = [], None
            elif tag in ("td", "th") and self._row is not None:
                self._cell = []
            elif tag == "br" and self._cell is not None:
                self._cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self._depth:
            self._depth -= 1
            if not self._depth:
                self._keep_cell()
                self.tables.append(self._rows + ([self._row] if self._row else []))
        elif self._depth == 1 and tag in ("tr", "td", "th"):
            self._keep_cell()
            if tag == "tr" and self._row is not None:
                self._rows.append(self._row)
                self._row = None

    def handle_data(self, data: str) -> None:
        if self._cell is not None and self._depth == 1:
            self._cell.append(data)


class ListParser(HTMLParser):
    """Texts of list items, without the items nested in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[str] = []
        self._open: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "li":
            self._open.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag == "li" and self._open:
            self.items.append(" ".join("".join(self._open.pop()).split()))

    def handle_data(self, data: str) -> None:
        if self._open:
            self._open[-1].append(data)


def parse_tables(page: str | None) -> list[list[list[str]]]:
    parser = TableParser()
    parser.feed(page or "")
    parser.close()
    return parser.tables


def _by_page(pages: DataFrame, key: str, column: str, rule, schema: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *r) for k, page in zip(batch[key], batch[column], strict=True) for r in rule(page)], columns=names)

    return pages.select(key, column).mapInPandas(run, f"{key} {kind}, {schema}")


def tables(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, table, row, cells of every row of every outermost table."""
    return _by_page(pages, key, column, lambda page: [(t, r, cells) for t, rows in enumerate(parse_tables(page)) for r, cells in enumerate(rows)], "table int, row int, cells array<string>")


def list_items(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, item of every list item with a text."""

    def rule(page: str | None) -> list[tuple[int, str]]:
        parser = ListParser()
        parser.feed(page or "")
        parser.close()
        return [(i, x) for i, x in enumerate(parser.items) if x]

    return _by_page(pages, key, column, rule, "place int, item string")


def named_column(rows: DataFrame, key: str, header: str, least: int) -> DataFrame:
    """key, row, name: the column under `header` in the first table that has it, aligned from the right.

    A page with fewer than `least` names raises an error, so that a changed page never passes for a short list.
    """
    heads = rows.withColumn("at", F.array_position(F.transform("cells", lambda c: F.lower(c)), header.lower())).filter("at > 0")
    first = heads.groupBy(key).agg(F.min(F.struct("table", "row", "at", F.size("cells").alias("width"))).alias("h"))
    body = rows.join(first, key).filter((F.col("table") == F.col("h.table")) & (F.col("row") > F.col("h.row")) & (F.size("cells") >= 2))
    place = F.col("h.at") + F.size("cells") - F.col("h.width")
    body = body.withColumn("place", place.cast("int")).filter("place >= 1 and place <= size(cells)").withColumn("name", F.element_at("cells", F.col("place"))).filter("name <> ''")
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = F.when(n >= least, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("only "), n.cast("string"), F.lit(" names on a page"))))
    return body.select(key, "row", checked.alias("name"))


#: Output field, and what its header contains.
LEVEL_FIELDS = (("pmc_level", "pmc level"), ("quests", "quest"), ("objectives", "objective"), ("skills", "skill"), ("hideout", "hideout"), ("items", "item"))


def levels(rows: DataFrame, key: str, header: str = "prestige level", least: int = 5) -> DataFrame:
    """key, level and text fields of the first table whose first row holds `header`; rows without a number go.

    Fields are found by what a header contains; of equal headers the last counts.  Fewer than `least` rows raise.
    """
    from pyspark.sql import Window

    heads = rows.filter((F.col("row") == 0) & F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(header))))
    first = heads.groupBy(key).agg(F.min(F.struct("table", "cells")).alias("h"))
    body = rows.join(first, key).filter((F.col("table") == F.col("h.table")) & (F.col("row") > 0))
    at = lambda k: F.array_max(F.filter(F.transform(F.col("h.cells"), lambda c, i: F.when(F.contains(F.lower(c), F.lit(k)), i)), lambda i: i.isNotNull()))
    value = lambda k: F.coalesce(F.get("cells", at(k).cast("int")), F.lit(""))
    number = F.regexp_extract(value(header), r"(\d+)", 1).try_cast("int")
    body = body.withColumn("level", number).filter("level is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = F.when(n >= least, F.col("level")).otherwise(F.raise_error(F.concat(F.lit("only "), n.cast("string"), F.lit(" levels on a page"))).cast("int"))
    return body.select(key, checked.alias("level"), *[value(k).alias(f) for f, k in LEVEL_FIELDS])
