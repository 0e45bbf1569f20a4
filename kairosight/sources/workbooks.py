"""Workbooks of spreadsheets (zip containers of XML parts): every sheet of every file, as rows of text cells.

Files come as rows (path, content), as Spark's binaryFile source reads them from any store, so files are spread over
tasks; a task parses one file at a time, sheet by sheet.  Cells are text as a reader of tables shows them: shared and inline
strings, whole numbers without a fraction, TRUE and FALSE, and dates and times (numbers with a date format) in ISO form.
Missing cells are null, and rows are as long as their last cell.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shipping import ship

_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the format's own date and time formats.
_DATES = {*range(14, 23), *range(45, 48)}
_FIRST_DAY = datetime(1899, 12, 30)


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str) -> list:
    return [c for c in node if _plain(c.tag) == name]


def _texts(node) -> str:
    """All text of a string item, without phonetic hints."""
    out = []
    for c in node:
        if _plain(c.tag) == "t":
            out.append(c.text or "")
        elif _plain(c.tag) == "r":
            out.append(_texts(c))
    return "".join(out)


def _part(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indices of cell styles that show a number as a date or time."""
    root = _part(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {}
    for group in _children(root, "numFmts"):
        for f in group:
            shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
            own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", shown, re.IGNORECASE))
    return {i for group in _children(root, "cellXfs") for i, x in enumerate(group) if own.get(n := int(x.get("numFmtId", "0")), n in _DATES)}


def _column(reference: str) -> int:
    """Place of a column from 0 by the letters of a cell reference."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell, strings: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_texts(i) for i in _children(cell, "is"))
    found = _children(cell, "v")
    raw = found[0].text if found else None
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    number = float(raw)
    if int(cell.get("s", "0")) in dates:
        return (_FIRST_DAY + timedelta(seconds=round(number * 86400))).isoformat(" ")
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """Number and name of the sheet, number of the row (from 1) and cells, of every row of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, relations = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels")
        if book is None or relations is None:
            raise ValueError("not a workbook")
        target = {r.get("Id"): r.get("Target") for r in relations}
        listed = _part(z, "xl/sharedStrings.xml")
        strings = [_texts(i) for i in listed] if listed is not None else []
        dates = _date_styles(z)
        for number, sheet in enumerate(s for group in _children(book, "sheets") for s in group):
            name = target[sheet.get(_RELATION)]
            with z.open(name.lstrip("/") if name.startswith("/") else f"xl/{name}") as part:
                last = 0
                for _, node in ElementTree.iterparse(part):
                    if _plain(node.tag) != "row":
                        continue
                    last = int(node.get("r", last + 1))
                    cells: list[str | None] = []
                    for c in _children(node, "c"):
                        at = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells) + 1)
                        cells[at] = _value(c, strings, dates)
                    yield number, sheet.get("name"), last, cells
                    node.clear()


def cells(files: DataFrame, strict: bool = True) -> DataFrame:
    """path, sheet_no, sheet, row, cells of files(path, content); a file that is no workbook is an error or, if not strict, has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(path, *r) for r in sheets(bytes(content))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    if strict:
                        raise
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet_no", "sheet", "row", "cells"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, row int, cells array<string>")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The cells of the workbooks at a path."""
    return cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).repartition("path"), strict)


def records(found: DataFrame) -> DataFrame:
    """path, sheet, row, fields: each row below the first of a sheet, by the names in that first one (trimmed; blank names and blank rows go)."""
    by = Window.partitionBy("path", "sheet_no")
    head = F.first("cells").over(by.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.min("row").over(by)
    below = found.withColumn("head", head).withColumn("first", first).where("row > first")
    named = F.arrays_zip(F.transform("head", lambda c: F.trim(c)).alias("k"), F.col("cells").alias("v"))
    kept = F.filter(named, lambda e: F.coalesce(e["k"], F.lit("")) != "")
    once = F.filter(kept, lambda e, i: F.array_position(F.transform(kept, lambda o: o["k"]), e["k"]) == i + 1)
    fields = F.map_from_entries(F.transform(once, lambda e: F.struct(e["k"], e["v"])))
    return below.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).select("path", "sheet", "row", fields.alias("fields"))
