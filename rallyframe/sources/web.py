"""Rows of HTML tables, as records."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """Cells of every table row, with the links in them. A nested table's rows
    are its own; an unclosed cell or row ends where the next one starts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.count = 0

    def _end_cell(self, t: dict) -> None:
        if t["text"] is not None:
            t["cells"].append(" ".join("".join(t["text"]).split()))
            t["links"].append(t["link"])
            t["text"], t["link"] = None, None

    def _end_row(self, t: dict) -> None:
        self._end_cell(t)
        if t["cells"]:
            self.rows.append({"table": t["n"], "row": t["row"], "header": t["header"], "cells": t["cells"], "links": t["links"]})
            t["row"] += 1
        t.update(cells=[], links=[], header=True)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"n": self.count, "row": 0, "header": True, "cells": [], "links": [], "text": None, "link": None})
            self.count += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._end_row(t)
            elif tag in ("td", "th"):
                self._end_cell(t)
                t["text"] = []
                t["header"] &= tag == "th"
            elif tag == "a" and t["text"] is not None and t["link"] is None:
                t["link"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if self.open:
            t = self.open[-1]
            if tag == "table":
                self._end_row(t)
                self.open.pop()
            elif tag == "tr":
                self._end_row(t)
            elif tag in ("td", "th"):
                self._end_cell(t)

    def handle_data(self, data):
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_row(self.open.pop())


def table_rows(page: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.rows


ROW = pa.list_(pa.struct([("table", pa.int32()), ("row", pa.int32()), ("header", pa.bool_()), ("cells", pa.list_(pa.string())), ("links", pa.list_(pa.string()))]))


def _batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([table_rows(x) for x in batch.column(1).to_pylist()], ROW)], ["key", "rows"])


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, header, cells, links) for every table row of each page."""
    kind = pages.schema[key].dataType.simpleString()
    made = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(_batches, f"key {kind}, rows array<struct<table:int,row:int,header:boolean,cells:array<string>,links:array<string>>>")
    return made.select(F.col("key").alias(key), F.explode("rows").alias("_r")).select(key, "_r.*")


def records(rows: DataFrame, key: str, table: int = 0) -> DataFrame:
    """(key, row, fields): cells by the names in the table's last header row.
    Cells beyond the names are left out; tables without a header give none."""
    own = rows.where(F.col("table") == table)
    names = own.where("header").groupBy(key).agg(F.max_by("cells", "row").alias("_names"))
    pair = F.map_from_entries(F.filter(F.arrays_zip(F.col("_names").alias("name"), F.slice("cells", 1, F.size("_names")).alias("cell")), lambda x: x["name"].isNotNull() & (x["name"] != "")))
    return own.where(~F.col("header")).join(names, key).select(key, "row", pair.alias("fields"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
