"""Rows of spreadsheet workbooks (xlsx), a task for each sheet.

Workbooks come as binary files, so any store that Spark reads will do. What a sheet holds is read from its XML as a stream of rows; strings are looked up in the workbook's table of strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PLACE = re.compile(r"([A-Z]+)(\d+)")
#: Rows that leave a task at once.
ROWS_AT_ONCE = 4096
SHEETS = "sheet string, part string, at int, error string"
ROWS = "sheet string, row int, cells array<string>"


def workbook_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the workbooks below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(folder)
    return files.select("path", "content")


def sheets_of(content: bytes) -> list[tuple[str, str]]:
    """Names of a workbook's sheets in order, and where their parts are."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        named = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        return [(s.get("name"), _part(links[s.get(_LINK)])) for s in named]


def _part(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    try:
        part = book.open("xl/sharedStrings.xml")
    except KeyError:
        return []
    with part:
        out = []
        for _, element in ElementTree.iterparse(part):
            if element.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in element.iter(f"{_MAIN}t")))
                element.clear()
        return out


def rows_of(content: bytes, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """The number of each row of a sheet that has cells, counted from 1, and its cells as strings from the first column on; an empty cell is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = _texts(book)
        with book.open(part) as sheet:
            number = 0
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    place = _PLACE.fullmatch(cell.get("r") or "")
                    at = _column(place[1]) if place else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, texts)
                row.clear()
                if any(c is not None for c in cells):
                    yield number, cells


def _value(cell: ElementTree.Element, texts: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    if value is None or value.text is None:
        return None
    return texts[int(value.text)] if kind == "s" else {"0": "false", "1": "true"}.get(value.text) if kind == "b" else value.text


def read_sheets(files: DataFrame, chosen: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (path, sheet, row, cells) of workbooks, and warnings (path, sheet, error) for what cannot be read: an unreadable workbook or sheet gives no rows and a warning. files: path, content; chosen: a
    condition on path and sheet. A workbook is listed first, then each of its sheets is read in a task of its own, so that a book of many sheets does not wait for one task."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    found = [(n, p, i, None) for i, (n, p) in enumerate(sheets_of(content.as_py() or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found = [(None, None, None, f"UNREADABLE_WORKBOOK: {type(e).__name__}")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True))], ["path", "sheet", "part", "at", "error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sheet, part, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sheet", "part", "content")), strict=True):
                held: list[tuple] = []
                try:
                    for number, cells in rows_of(content, part):
                        held.append((number, cells, None))
                        if len(held) >= ROWS_AT_ONCE:
                            yield _batch(path, sheet, held)
                            held = []
                except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, IndexError) as e:
                    held.append((None, None, f"UNREADABLE_SHEET: {type(e).__name__}"))
                if held:
                    yield _batch(path, sheet, held)

    names = files.mapInArrow(listed, f"path string, {SHEETS}")
    found = names.filter("error is null")
    if chosen is not None:
        found = found.filter(chosen)
    parts = found.repartition("path", "sheet").join(files, "path")
    told = parts.select("path", "sheet", "part", "content").mapInArrow(read, "path string, sheet string, row int, cells array<string>, error string")
    warned = names.filter("error is not null").select("path", "sheet", "error").unionByName(told.filter("error is not null").select("path", "sheet", "error"))
    return told.filter("error is null").drop("error"), warned


def _batch(path: str, sheet: str, held: list[tuple]) -> pa.RecordBatch:
    rows, cells, errors = zip(*held, strict=True)
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([sheet] * n), pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.string())), pa.array(errors, pa.string())], ["path", "sheet", "row", "cells", "error"])


#: Columns of the guideline sheet, its first row, and the columns that are filled down.
GUIDELINE_COLUMNS = {"transport_type": 1, "order_detail": 2, "doc_type": 3, "so_lien_in": 4, "giao_nvc": 5, "nvc_mang_ve": 6, "dien_giai": 7}
GUIDELINE_SHEET, GUIDELINE_FIRST_ROW, GUIDELINE_LINK = "Guideline", 3, 8


def guidelines(rows: DataFrame) -> DataFrame:
    """path, row and the guideline's columns of read_sheets() rows: transport type and order are filled down from the last row that has them, rows without a document are left out, and the form's sheet is what a link points to."""
    from paperweave.operators.records import filled_down

    own = rows.filter((F.col("sheet") == GUIDELINE_SHEET) & (F.col("row") >= GUIDELINE_FIRST_ROW))
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    told = own.select("path", "row", *(cell(i).alias(n) for n, i in GUIDELINE_COLUMNS.items()), cell(GUIDELINE_LINK).alias("link"))
    for name in ("transport_type", "order_detail"):
        told = filled_down(told, "path", "row", name)
    form = F.regexp_replace(F.split_part(F.coalesce("link", F.lit("")), F.lit("'!"), F.lit(1)), "^'+|'+$", "")
    return told.filter("doc_type is not null").withColumn("form_sheet", form).drop("link")
