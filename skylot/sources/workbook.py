"""A data source that reads the sheets of XLSX workbooks, a partition a sheet: spark.read.format("workbook").load(path).

Rows come as (sheet, row, cells): cells are texts, as the file has them; empty cells are null, and rows are as wide as their
last cell. Numbers keep their shortest form (44000, not 44000.0). Sheets are parsed as streams, so a sheet of any length needs
the memory of a row and of the workbook's table of shared texts.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        super().__init__((path, name, part))
        self.path, self.name, self.part = path, name, part


def _column(reference: str) -> int:
    """AB12 -> 27."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _said(node: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic hints."""
    return "".join(t.text or "" for t in [*node.findall(f"{_MAIN}t"), *node.findall(f"{_MAIN}r/{_MAIN}t")])


def _number(text: str) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        with zipfile.ZipFile(self.path) as book:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
            part = lambda t: t[1:] if t.startswith("/") else f"xl/{t}"
            return [Sheet(self.path, s.get("name"), part(targets[s.get(_RELATION)])) for s in sheets]

    def read(self, partition: Sheet) -> Iterator[tuple[str, int, list[str | None]]]:
        with zipfile.ZipFile(partition.path) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = [_said(node) for node in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            with book.open(partition.part) as sheet:
                number = 0
                for _, node in ElementTree.iterparse(sheet):
                    if node.tag != f"{_MAIN}row":
                        continue
                    number = int(node.get("r") or number + 1)
                    cells: list[str | None] = []
                    for cell in node.iter(f"{_MAIN}c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                        if kind == "inlineStr":
                            cells[at] = _said(cell.find(f"{_MAIN}is"))
                        elif value is not None:
                            cells[at] = shared[int(value)] if kind == "s" else _number(value) if kind == "n" else value
                    node.clear()
                    if any(c is not None for c in cells):
                        yield partition.name, number, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def sheets(spark: SparkSession, path: str):
    """(sheet, row, cells) of a workbook."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)
