"""Workbooks (.xlsx) out of Spark: a data source that writes each partition as workbooks of its own.

``df.write.format("workbook").save(folder)`` after ``spark.dataSource.register(Workbook)``.  A task streams its rows into
the zipped XML of a sheet, so a row is in memory once and nothing is collected; a sheet ends at ``SHEET_ROWS`` rows,
the most that readers take, and goes on as another workbook.  Files are written under names of the attempt and moved
when all tasks are done, so a task that is run again leaves nothing twice; an aborted write removes them.

Values: numbers and booleans as such, where a spreadsheet holds them exactly (whole numbers up to 2^53); all else as
text; null, NaN and infinite values as empty cells.  Texts lose what XML cannot hold (control characters) and end at
32,767 characters, the most of a cell, both limits of the format.  An empty result is one workbook with its header.

``read_workbook`` reads a workbook of this layout back, for tests and small files.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Limits and names of the format, as fixed values.
SHEET_ROWS, CELL_CHARS, EXACT = 1_048_576, 32_767, 1 << 53
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def cell(value) -> str:
    """A value as a cell of XML."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)):
        if isinstance(value, float) and not math.isfinite(value):
            return "<c/>"
        if not isinstance(value, int) or abs(value) <= EXACT:
            return f"<c><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"<c><v>{value}</v></c>"
    if isinstance(value, (datetime.date, datetime.datetime)):
        value = value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat()
    text = _FORBIDDEN.sub("", value if isinstance(value, str) else str(value))[:CELL_CHARS]
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class Sheet:
    """One workbook, written row by row."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.rows = path, 0
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        for name, xml in _PARTS.items():
            self.zip.writestr(name, _HEAD + xml)
        self.out = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.add(names)

    def add(self, values) -> None:
        self.rows += 1
        self.out.write(f"<row>{''.join(map(cell, values))}</row>".encode())

    def close(self) -> None:
        self.out.write(b"</sheetData></worksheet>")
        self.out.close()
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, folder: str, sheet_rows: int, old: list[str]):
        self.names, self.folder, self.sheet_rows, self.old = schema.names, folder, sheet_rows, old

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId() if context else 0:05d}"
        files, rows, sheet = [], 0, None
        for row in iterator:
            if sheet is None or sheet.rows == self.sheet_rows:
                if sheet:
                    sheet.close()
                files.append(f"{stem}-{len(files):03d}.xlsx")
                hidden = f".{files[-1]}.{uuid.uuid4().hex}"
                sheet = Sheet(os.path.join(self.folder, hidden), self.names)
                files[-1] = hidden
            sheet.add(row)
            rows += 1
        if sheet:
            sheet.close()
        return Written(files, rows)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        for name in self.old:
            os.unlink(os.path.join(self.folder, name))
        if not files:
            os.makedirs(self.folder, exist_ok=True)
            Sheet(os.path.join(self.folder, "part-00000-000.xlsx"), self.names).close()
        for hidden in files:
            os.replace(os.path.join(self.folder, hidden), os.path.join(self.folder, hidden[1:].rsplit(".", 1)[0]))

    def abort(self, messages: list) -> None:
        for hidden in [f for m in messages if m for f in m.files]:
            os.unlink(os.path.join(self.folder, hidden))


class Workbook(DataSource):
    """``path`` must be a folder that the driver and all executors share, as the format's writer works on files."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        scheme, folder = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(.*)", self.options["path"], re.DOTALL).groups()
        if scheme not in (None, "file"):
            raise ValueError(f"a workbook goes to a shared folder, not to {scheme}")
        folder = folder if scheme is None else "/" + folder.lstrip("/")
        old = [f for f in os.listdir(folder) if f.endswith(".xlsx")] if os.path.isdir(folder) else []
        if old and not overwrite:
            raise ValueError(f"{folder} holds workbooks already")
        return _Writer(schema, folder, int(self.options.get("sheet_rows", SHEET_ROWS)), old)


def read_workbook(path: str) -> list[list]:
    """The rows of a workbook, the header first; cells as numbers, booleans, texts or None."""
    ns = f"{{{_MAIN}}}"

    def value(c):
        kind, v = c.get("t"), c.find(f"{ns}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{ns}t"))
        if v is None:
            return None
        return v.text == "1" if kind == "b" else int(v.text) if re.fullmatch(r"-?\d+", v.text) else float(v.text)

    with zipfile.ZipFile(path) as z, z.open("xl/worksheets/sheet1.xml") as f:
        return [[value(c) for c in row] for _, row in ElementTree.iterparse(f) if row.tag == f"{ns}row"]
