"""Spreadsheet workbooks as a long cell table, many files at once.

A workbook is a zip archive and cannot be split, so one task reads one file;
the sheet is parsed as a stream and handed on in batches.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet string, row_idx int, col_idx int, value string"
BATCH_CELLS = 50_000

# The namespace of relationship ids in a workbook.
OFFICE_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    """All text runs of a node, without phonetic hints."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_texts(child))
    return "".join(parts)


def _column(ref: str) -> int:
    number = 0
    for letter in ref.rstrip("0123456789").upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name to archive member."""
    targets = {
        rel.get("Id"): rel.get("Target") for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [n for n in tree.iter() if _local(n.tag) == "sheet"]
    return {
        s.get("name"): posixpath.normpath(posixpath.join("/xl", targets[s.get(OFFICE_REL)])).lstrip("/")
        for s in sheets
        if s.get(OFFICE_REL) in targets
    }


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_texts(n) for _, n in ElementTree.iterparse(part) if _local(n.tag) == "si"]


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t")
    for child in cell:
        if kind == "inlineStr" and _local(child.tag) == "is":
            return _texts(child)
        if kind != "inlineStr" and _local(child.tag) == "v":
            text = child.text or ""
            return shared[int(text)] if kind == "s" and text else text
    return ""


def sheet_cells(content: bytes, sheet: str | None) -> Iterator[tuple[str, int, int, str]]:
    """``(sheet, row, column, text)``, counting only rows that have cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_texts(book)
        for name, part in _sheet_parts(book).items():
            if sheet is not None and name != sheet:
                continue
            row_idx = 0
            with book.open(part) as xml:
                for _, node in ElementTree.iterparse(xml):
                    if _local(node.tag) != "row":
                        continue
                    cells = [c for c in node if _local(c.tag) == "c"]
                    for cell in cells:
                        yield name, row_idx, _column(cell.get("r", "A1")), _cell_text(cell, shared)
                    row_idx += bool(cells)
                    node.clear()


def workbook_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Cell table of a ``path, content`` table of workbooks, all sheets or one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "row_idx", "col_idx", "value"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for cell in sheet_cells(content, sheet):
                    rows.append((path, *cell))
                    if len(rows) == BATCH_CELLS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, CELLS)


def read_workbooks(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return workbook_cells(files, sheet)
