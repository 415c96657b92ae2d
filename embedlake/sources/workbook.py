"""Cells of one sheet of xlsx workbooks, one task per workbook."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from embedlake.sources.remote import open_for_reading

ROW_SCHEMA = "path string, cells map<string,string>, malformed boolean"
BATCH_ROWS = 2000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _sheet_path(book: zipfile.ZipFile, index: int) -> str:
    sheets = [
        e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"
    ]
    wanted = next(v for k, v in sheets[index].attrib.items() if _local(k) == "id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise KeyError(f"sheet {index}")


def sheet_rows(file, index: int = 0) -> Iterator[list[str | None]]:
    """Cell texts row by row; the sheet is parsed as a stream."""
    with zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(item) for item in root]
        with book.open(_sheet_path(book, index)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if _local(row.tag) != "row":
                    continue
                values: list[str | None] = []
                for place, cell in enumerate(row):
                    column = _column(cell.get("r")) if cell.get("r") else place
                    values.extend([None] * (column - len(values)))
                    raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
                    if cell.get("t") == "s":
                        raw = shared[int(raw)]
                    elif cell.get("t") == "inlineStr":
                        raw = _text(cell)
                    values.append(raw)
                yield values
                row.clear()


def read_workbooks(files: DataFrame, sheet: int = 0) -> DataFrame:
    """One ``cells`` map per data row; the first row names the columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                batch: list = []
                try:
                    with open_for_reading(path) as raw:
                        rows = sheet_rows(raw, sheet)
                        header = next(rows, [])
                        for values in rows:
                            cells = dict.fromkeys([h for h in header if h is not None])
                            cells.update((h, v) for h, v in zip(header, values) if h is not None)
                            batch.append((path, cells, False))
                            if len(batch) == BATCH_ROWS:
                                yield pd.DataFrame(batch, columns=["path", "cells", "malformed"])
                                batch = []
                except (OSError, KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    batch.append((path, None, True))
                if batch:
                    yield pd.DataFrame(batch, columns=["path", "cells", "malformed"])

    return files.select("path").mapInPandas(run, ROW_SCHEMA)
