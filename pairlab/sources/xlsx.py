"""Sheets of XLSX workbooks as rows of cells, and the sector tables that come in them.

Spark reads the files, wherever they lie; a task takes a workbook at a time and streams the rows of one sheet out of
its zip. Workbooks of this kind are lists of some thousand rows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a record batch.
_BATCH = 5000


def _text(node) -> str:
    """The text of a string item: plain, or of all its runs; reading aids aren't part of it."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == _MAIN + "t" else part.iter(_MAIN + "t") if part.tag == _MAIN + "r" else []))


def _column(ref: str) -> int:
    """Column of a reference such as AB12, from 0."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of one sheet; a cell without a value is None, and rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(_REL) for s in book.iter(_MAIN + "sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(map(str, ids))}")
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == ids[sheet])
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        last = 0
        with z.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(_MAIN + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    value = c.find(_MAIN + "v")
                    if c.get("t") == "inlineStr":
                        inline = c.find(_MAIN + "is")
                        own = _text(inline) if inline is not None else None
                    elif value is None or value.text is None:
                        own = None
                    else:
                        own = shared[int(value.text)] if c.get("t") == "s" else value.text
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = own
                last = int(row.get("r") or last + 1)
                if cells:
                    yield last, cells
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(path, row_no, cells) of a sheet in one or many workbooks; raises where a workbook lacks the sheet."""

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(sheet_rows(content, sheet))
                for lo in range(0, len(rows), _BATCH):
                    numbers, cells = zip(*rows[lo : lo + _BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(numbers)), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["path", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no int, cells array<string>")


def named_columns(rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """A column for each of ``wanted(name: (heading, place))`` below each workbook's first row.

    A column is found by its heading, of equal headings the last, and by its place where no heading is so called. Values are
    trimmed; an empty one is null.
    """
    first = rows.groupBy("path").agg(F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("head_no"))  # a row a workbook
    below = rows.join(F.broadcast(first), "path").filter(F.col("row_no") > F.col("head_no"))
    heads = F.transform("head", F.trim)

    def cell(heading: str, place: int) -> Column:
        found = F.array_position(F.reverse(heads), heading)
        at = F.when(found > 0, F.size("head") - found).otherwise(F.lit(place)).cast("int")
        value = F.trim(F.get("cells", at))
        return F.when(value != "", value)

    return below.select("path", "row_no", *[cell(*at).alias(name) for name, at in wanted.items()])


def read_sectors(spark: SparkSession, path: str, sheet: str = "ind_nifty500list") -> DataFrame:
    """(symbol, company_name, industry, isin) of the sheet; symbols and industries in capitals, rows without a symbol left out. Raises if there are no rows."""
    rows = read_sheet(spark, path, sheet)
    if not rows.limit(1).count():
        raise ValueError(f"the sheet {sheet} is empty")
    found = named_columns(rows, {"company_name": ("Company Name", 0), "industry": ("Industry", 1), "symbol": ("Symbol", 2), "isin": ("ISIN Code", 4)})
    return found.select(F.upper("symbol").alias("symbol"), "company_name", F.upper("industry").alias("industry"), "isin").filter("symbol IS NOT NULL")


def read_second_industry(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(isin, bse_industry) of the exchange's list of securities, for tables.with_second_industry; rows without an ISIN are left out."""
    found = named_columns(read_sheet(spark, path, sheet), {"isin": ("ISIN No", 0), "bse_industry": ("Industry", 9)})
    return found.filter("isin IS NOT NULL").select("isin", "bse_industry")
