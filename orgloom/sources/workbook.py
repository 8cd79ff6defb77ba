"""Workbooks (Office Open XML) as a data source: rows of a sheet are read by ranges, and written by tasks.

A sheet's XML is streamed out of its zip, so a task holds a row at a time, and the strings that the workbook shares.
Paths may be of any file system that Arrow knows, and must be seen by the driver and all executors.
"""

from __future__ import annotations

import datetime
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_SHEET, _STRINGS = re.compile(r"xl/worksheets/sheet\d+\.xml"), "xl/sharedStrings.xml"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
# The other parts that a workbook of one sheet has.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    system, base = _place(path)
    if system.get_file_info(base).type == fs.FileType.File:
        return [base]
    found = system.get_file_info(fs.FileSelector(base))
    return sorted(x.path for x in found if x.path.endswith(".xlsx") and not x.base_name.startswith(("_", ".")))


def _column(ref: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node: ElementTree.Element) -> str:
    """A string item's text, in whatever runs it is written."""
    return "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if _STRINGS not in book.namelist():
        return []
    with book.open(_STRINGS) as f:
        return [_text(node) for _, node in ElementTree.iterparse(f) if node.tag == f"{{{_MAIN}}}si"]


def sheet_rows(book: zipfile.ZipFile, first: int, last: int | None) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Rows ``first`` to ``last`` (numbered from 1, as in the sheet): their number, and the text of each cell."""
    shared, number = _shared(book), 0
    member = next(n for n in sorted(book.namelist()) if _SHEET.fullmatch(n))
    with book.open(member) as f:
        parser = iter(ElementTree.iterparse(f, ("start", "end")))
        top = next(parser)[1]
        for event, node in parser:
            if event == "end" and node.tag == f"{{{_MAIN}}}row":
                number = int(node.get("r") or number + 1)
                if last is not None and number > last:
                    return
                if number >= first:
                    cells: dict[int, str | None] = {}
                    at = -1
                    for cell in node.iter(f"{{{_MAIN}}}c"):
                        at = _column(cell.get("r")) if cell.get("r") else at + 1
                        value, kind = cell.find(f"{{{_MAIN}}}v"), cell.get("t")
                        written = None if value is None else value.text
                        cells[at] = _text(cell) if kind == "inlineStr" else shared[int(written)] if kind == "s" and written else written
                    yield number, cells
                node.clear()
                for child in top:  # rows that are done are not kept
                    child.clear()


def _typed(text: str | None, kind: T.DataType) -> object:
    """A cell as its column's type; null where it can't be one."""
    if text is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return text
        if isinstance(kind, T.BooleanType):
            return {"1": True, "0": False, "true": True, "false": False}[text.strip().lower()]
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else int(float(text)) if float(text).is_integer() else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(text[:10])
    except (ValueError, KeyError, OverflowError):
        return None
    raise ValueError(f"a workbook has no cells of {kind.simpleString()}")


@dataclass
class Range(InputPartition):
    file: str
    first: int
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, header: bool, rows_per_task: int):
        self.path, self.schema, self.header, self.step = path, schema, header, rows_per_task

    def partitions(self) -> list[Range]:
        """Ranges of rows of each file, by the dimension that its sheet states; all of a file that states none."""
        system, _ = _place(self.path)
        first, out = 1 + self.header, []
        for file in _files(self.path):
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                with book.open(next(n for n in sorted(book.namelist()) if _SHEET.fullmatch(n))) as sheet:
                    stated = re.search(rb'<dimension\s+ref="[A-Z]+\d+:[A-Z]+(\d+)"', sheet.read(4096))
            rows = int(stated[1]) if stated else 0
            starts = list(range(first, rows + 1, self.step)) or [first]
            out += [Range(file, a, b - 1 if b else None) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _place(self.path)
        with system.open_input_file(partition.file) as f, zipfile.ZipFile(f) as book:
            places = dict(enumerate(self.schema.names))
            if self.header:
                head = next(sheet_rows(book, 1, 1), (1, {}))[1]
                known = {v: k for k, v in reversed(head.items())}
                places = {known[n]: n for n in self.schema.names if n in known}
            at = {n: k for k, n in places.items()}
            for _, cells in sheet_rows(book, partition.first, partition.last):
                yield tuple(_typed(cells.get(at.get(x.name, -1)), x.dataType) for x in self.schema.fields)


@dataclass
class Written(WriterCommitMessage):
    file: str


class _Writer(DataSourceWriter):
    """Each task writes a workbook aside; the commit moves those of tasks that counted to their place."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, header: bool):
        self.path, self.schema, self.overwrite, self.header, self.run = path, schema, overwrite, header, uuid.uuid4().hex[:12]

    def _cell(self, ref: str, value: object) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value!r}</v></c>'
        text = re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", str(value))  # what XML can't hold
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, base = _place(self.path)
        aside = f"{base}/_aside-{self.run}"
        system.create_dir(aside, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.run}-{TaskContext.get().taskAttemptId()}.xlsx"
        names = [_name(i) for i in range(len(self.schema.names))]
        head = [self.schema.names] if self.header else []
        with system.open_output_stream(f"{aside}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in _PARTS.items():
                book.writestr(part, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for number, row in enumerate((r for part in (head, rows) for r in part), 1):
                    cells = "".join(self._cell(f"{c}{number}", v) for c, v in zip(names, row, strict=True))
                    sheet.write(f'<row r="{number}">{cells}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        if self.overwrite:
            for old in _files(self.path):
                system.delete_file(old)
        for m in messages:
            if m is not None:
                system.move(f"{base}/_aside-{self.run}/{m.file}", f"{base}/{m.file}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/_aside-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_aside-{self.run}")


class Workbook(DataSource):
    """``spark.read.format("workbook").schema(...).load(path)`` and ``df.write.format("workbook").save(path)``.

    Options: ``header`` (true: the first row names the columns, in any order) and ``rowsPerTask`` (100000), for sheets
    that state their dimension. Cells that aren't of their column's type, and missing ones, are null.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("a workbook is read with a schema")

    def _header(self) -> bool:
        return str(self.options.get("header", "true")).lower() == "true"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, self._header(), int(self.options.get("rowsPerTask", 100_000)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite, self._header())


def register(spark: SparkSession) -> None:
    """Makes the format "workbook" known to the session."""
    spark.dataSource.register(Workbook)
