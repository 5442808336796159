"""Workbooks (Office Open XML) as a source: an inventory of sheets, and cell ranges read by row ranges.

A workbook is a zip of XML members. Each partition streams its sheet's member up to its last row
and keeps none but its own rows; of the shared strings it picks those that its cells name, in a
second stream. Neither driver nor task holds a sheet.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.sources.stores import opened, register

#: Rows of a partition.
ROWS = 10_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@contextmanager
def _book(path: str):
    store, name = opened(path)
    with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        yield z


def column_number(letters: str) -> int:
    """A is 1, Z is 26, AA is 27."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_range(cells: str | None) -> tuple[int, int, int | None, int | None]:
    """First and last column, first and last row of `B2:D9`, `B:D`, `2:9` or nothing; None is without an end."""
    m = re.fullmatch(r"\$?([A-Za-z]*)\$?(\d*)(?::\$?([A-Za-z]*)\$?(\d*))?", cells or "")
    if not m:
        raise ValueError(f"no range of cells: {cells}")
    a, one, b, two = m.groups()
    if cells and ":" not in cells:
        b, two = a, one
    return column_number(a) if a else 1, int(one or 1), column_number(b) if b else None, int(two) if two else None


def sheet_members(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets, in order."""
    links = {}
    with z.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if e.tag.endswith("Relationship"):
                target = e.get("Target")
                links[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    with z.open("xl/workbook.xml") as f:
        return [(e.get("name"), links[e.get(LINK)]) for _, e in iterparse(f) if e.tag == f"{MAIN}sheet"]


def _rows(z: zipfile.ZipFile, member: str, first: int, last: int | None) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """(row, {column: (kind, text)}) of the rows from first to last that have cells; kind `s` is the number of a shared string."""
    with z.open(member) as f:
        number, held = 0, None
        for event, e in iterparse(f, events=("start", "end")):
            if event == "start":
                if e.tag == f"{MAIN}sheetData":
                    held = e
                elif e.tag == f"{MAIN}row":
                    number = int(e.get("r") or number + 1)
                    if last is not None and number > last:
                        return
            elif e.tag == f"{MAIN}row":
                if number >= first:
                    cells, at = {}, 0
                    for c in e.iter(f"{MAIN}c"):
                        at = column_number(re.match("[A-Za-z]+", c.get("r"))[0]) if c.get("r") else at + 1
                        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else v.text if v is not None else None
                        if text is not None:
                            cells[at] = (kind, {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text)
                    if cells:
                        yield number, cells
                held.clear()


def _strings(z: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of these numbers; readings (phonetic runs) are no part of them."""
    found: dict[int, str] = {}
    if not wanted:
        return found
    with z.open("xl/sharedStrings.xml") as f:
        n, top = 0, None
        for event, e in iterparse(f, events=("start", "end")):
            if event == "start" and e.tag == f"{MAIN}sst":
                top = e
            elif event == "end" and e.tag == f"{MAIN}si":
                if n in wanted:
                    runs = [e, *e.findall(f"{MAIN}r")]
                    found[n] = "".join(t.text or "" for r in runs for t in r.findall(f"{MAIN}t"))
                    if len(found) == len(wanted):
                        return found
                n += 1
                top.clear()
    return found


def _texts(z: zipfile.ZipFile, rows: list[tuple[int, dict[int, tuple[str, str]]]]) -> list[tuple[int, dict[int, str]]]:
    shared = _strings(z, {int(v) for _, cells in rows for kind, v in cells.values() if kind == "s"})
    return [(n, {c: shared[int(v)] if kind == "s" else v for c, (kind, v) in cells.items()}) for n, cells in rows]


@dataclass
class Piece(InputPartition):
    member: str
    first: int
    last: int


class Workbook(DataSource):
    """Options: path, sheet (the one with data by default), cells (a range), header (true by default), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _found(self) -> tuple[str, int, int, int, int, dict[int, str]]:
        """Member, columns, rows and the header of the range: one stream over the sheet for its extent, in which cells are dropped at once."""
        left, top, right, bottom = cell_range(self.options.get("cells"))
        with _book(self.options["path"]) as z:
            sheets = dict(sheet_members(z))
            wanted = self.options.get("sheet")
            if wanted is not None and wanted not in sheets:
                raise ValueError(f"no sheet {wanted}, only {sorted(sheets)}")
            names = [wanted] if wanted is not None else [n for n, m in sheets.items() if next(_rows(z, m, 1, None), None)]
            if len(names) != 1:
                raise ValueError(f"expected one sheet with data, found {names}")
            member, first, last, far = sheets[names[0]], None, 0, 0
            for n, cells in _rows(z, member, top, bottom):
                own = [c for c in cells if c >= left and (right is None or c <= right)]
                if own:
                    first, last, far = first or n, n, max(far, *own)
            head = self.options.get("header", "true").lower() == "true"
            if first is None:
                return member, left, right or left, 1, 0, {}
            # A range that is given begins at its first row, any other where its data begin.
            begin = top if self.options.get("cells") else first
            header = dict(_texts(z, list(_rows(z, member, begin, begin)))).get(begin, {}) if head else {}
            return member, left, right or far, begin + head, last, header

    def schema(self) -> StructType:
        _, left, right, _, _, header = self._found()
        names: list[str] = []
        for c in range(left, right + 1):
            name = header.get(c) or column_letters(c)
            names.append(name if name.lower() not in {n.lower() for n in names} else f"{name}_{column_letters(c)}")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        member, left, right, first, last, _ = self._found()
        return WorkbookReader(self.options["path"], member, left, right, first, last, int(self.options.get("rows", ROWS)))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, member: str, left: int, right: int, first: int, last: int, rows: int):
        self.path, self.member, self.left, self.right, self.first, self.last, self.rows = path, member, left, right, first, last, rows

    def partitions(self) -> list[Piece]:
        return [Piece(self.member, at, min(at + self.rows - 1, self.last)) for at in range(self.first, self.last + 1, self.rows)] or [Piece(self.member, 1, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.last < partition.first:
            return
        with _book(self.path) as z:
            held = [(n, {c: v for c, v in cells.items() if self.left <= c <= self.right}) for n, cells in _rows(z, partition.member, partition.first, partition.last)]
            for _, cells in _texts(z, [h for h in held if h[1]]):
                yield tuple(cells.get(c) for c in range(self.left, self.right + 1))


class Sheets(DataSource):
    """Options: path. A row for each sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook_sheets"

    def schema(self) -> str:
        return "place int, sheet string, cells string, rows long, filled long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetsReader(self.options["path"])


class SheetsReader(DataSourceReader):
    """A partition for each sheet."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        with _book(self.path) as z:
            return [Piece(name, i, i) for i, (name, _) in enumerate(sheet_members(z))]

    def read(self, partition: Piece) -> Iterator[tuple]:
        with _book(self.path) as z:
            rows = filled = 0
            box = None
            for n, cells in _rows(z, dict(sheet_members(z))[partition.member], 1, None):
                rows, filled = rows + 1, filled + len(cells)
                a, b = min(cells), max(cells)
                box = (min(a, box[0]), box[1], max(b, box[2]), n) if box else (a, n, b, n)
            cells = f"{column_letters(box[0])}{box[1]}:{column_letters(box[2])}{box[3]}" if box else None
            yield partition.first, partition.member, cells, rows, filled


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """The sheets of a workbook: place, name, the range that has values, rows with values, values."""
    return spark.read.format(register(spark, Sheets)).option("path", path).load()


def workbook(spark: SparkSession, path: str, sheet: str | None = None, cells: str | None = None, header: bool = True, rows: int = ROWS) -> DataFrame:
    """A range of cells (`A1:F20`, `C:E`) of a sheet, by default all of the only one with data; every column is text as stored, rows without a value in the range go.

    The first row names the columns; columns without a name get their letters, and a name that is
    there already gets them behind it. A sheet without data has one column and no rows.
    """
    options = {"path": path, "header": str(header).lower(), "rows": str(rows)} | ({"sheet": sheet} if sheet is not None else {}) | ({"cells": cells} if cells else {})
    return spark.read.format(register(spark, Workbook)).options(**options).load()


def write_workbook(path: str, tables: dict[str, tuple[list[str], list[tuple]]]) -> None:
    """A small workbook with a sheet for each (header, rows): texts as shared strings, numbers as numbers, nothing for None."""
    from xml.sax.saxutils import escape, quoteattr

    strings: dict[str, int] = {}
    out = {}

    def cell(row: int, column: int, v) -> str:
        at = f"{column_letters(column + 1)}{row}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'

    names = list(tables)
    ns = f'xmlns="{MAIN[1:-1]}"'
    for i, (header, rows) in enumerate(tables.values(), 1):
        body = "".join(f'<row r="{n}">{"".join(cell(n, c, v) for c, v in enumerate(r))}</row>' for n, r in enumerate(([tuple(header)] if header else []) + rows, 1))
        out[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    out["xl/sharedStrings.xml"] = f"<sst {ns}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out["xl/workbook.xml"] = f'<workbook {ns} xmlns:r="{links}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>"
    out["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{links}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>"
    store, name = opened(path)
    with store.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in out.items():
            z.writestr(member, text)
