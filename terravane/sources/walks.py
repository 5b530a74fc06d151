"""Sources read by walking: cursors with a time budget, object listings with continuation, spreadsheets."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Report:
    """How far a walk came: complete, or partial with the cursor to go on from."""

    complete: bool
    pages: int
    rows: int
    cursor: str | None


def cursor_walk(fetch: Callable[[str | None], tuple[list, str | None]], budget: float, start: str | None = None, tries: int = 3, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep) -> tuple[list, Report]:
    """(rows, report) of pages that fetch(cursor) returns as (rows, next cursor), until there is none or the budget is spent.

    A cursor names the next page, so pages cannot be read side by side; a page that fails is tried again. The rows are
    those of a catalogue, which the driver holds; what was not read can be read later from the report's cursor."""
    begun, cursor, rows, pages = clock(), start, [], 0
    while True:
        for attempt in range(tries):
            try:
                page, cursor_next = fetch(cursor)
                break
            except OSError:
                if attempt + 1 == tries:
                    raise
                pause(0.1 * 2**attempt)
        rows += page
        pages, cursor = pages + 1, cursor_next
        if cursor is None:
            return rows, Report(True, pages, len(rows), None)
        if clock() - begun > budget:
            return rows, Report(False, pages, len(rows), cursor)


def listed_objects(spark: SparkSession, list_page: Callable[[str, str | None], dict], prefix: str, budget: float = 3600.0) -> tuple[DataFrame, list[str], Report]:
    """((key, bytes) of the objects below a prefix, the folders there, report) from pages {contents, folders, next}."""
    folders: list[str] = []

    def fetch(token: str | None) -> tuple[list, str | None]:
        page = list_page(prefix, token)
        folders.extend(f for f in page.get("folders", []) if f not in folders)
        return [(c["key"], int(c["bytes"])) for c in page.get("contents", [])], page.get("next")

    rows, report = cursor_walk(fetch, budget)
    return spark.createDataFrame(rows, "key string, bytes long"), folders, report


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_cells(data: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every cell with a value in a workbook, from 0; of one sheet if it is named."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
        if sheet is not None and s.get("name") != sheet:
            continue
        target = targets[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for i, row in enumerate(root.find("m:sheetData", _NS)):
            number = int(row.get("r", i + 1)) - 1
            for j, cell in enumerate(row):
                kind, value = cell.get("t"), cell.find("m:v", _NS)
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else {"0": "false", "1": "true"}[value.text] if kind == "b" else value.text
                yield s.get("name"), number, _column(cell.get("r")) if cell.get("r") else j, text


def read_sheets(spark: SparkSession, pattern: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, column, text) of the workbooks that a pattern finds, one workbook for each row of a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, data in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame([(path, *c) for c in sheet_cells(bytes(data), sheet)], columns=["path", "sheet", "row", "column", "text"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row int, column int, text string")


def sheet_table(cells: DataFrame, header: int = 0) -> DataFrame:
    """One sheet's cells as a table with text columns named by the header's row; columns without a name are left out."""
    names = {r["column"]: r.text for r in cells.filter(F.col("row") == header).select("column", "text").distinct().collect()}  # one row of a sheet
    rows = cells.filter(F.col("row") > header).groupBy("path", "sheet", "row").pivot("column", sorted(names)).agg(F.first("text"))
    return rows.select("row", *(F.col(str(c)).alias(n) for c, n in sorted(names.items())))
