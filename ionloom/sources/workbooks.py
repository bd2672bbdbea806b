"""Spreadsheets in Office Open XML (.xlsx): the first sheet of each file, its first row as names.

Files are read as bytes by Spark, wherever they lie, and taken apart one at a time in the tasks; rows come
out as they are parsed.  Writing is a Python data source: every task writes files of its own under names
that no other attempt has, and the commit puts them in place, so lost tasks leave nothing behind.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed values of the format: rows and columns of a sheet, and its parts' kinds.
ROWS, COLUMNS = 1_048_576, 16_384
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODE = re.compile("_x([0-9A-Fa-f]{4})_")


def letters(column: int) -> str:
    """The name of a column, counted from 0."""
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def number(reference: str) -> int:
    """The place of a cell's column, from 0."""
    out = 0
    for c in reference.rstrip("0123456789").upper():
        out = 26 * out + ord(c) - 64
    return out - 1


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _plain(text: str) -> str:
    """Text with the format's codes for characters replaced."""
    return _CODE.sub(lambda m: chr(int(m[1], 16)), text)


def _said(element) -> str:
    """The text of a string: of itself or of all its runs, but not of phonetic ones."""
    return _plain("".join(t.text or "" for run in element if _tag(run) != "rPh" for t in run.iter() if _tag(t) == "t"))


def _value(kind: str, text: str, shared: list[str]) -> str | None:
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    return None if kind == "e" else _plain(text) if kind == "str" else text


def _first_sheet(book: zipfile.ZipFile) -> str:
    try:
        sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[0].get(f"{{{RELATIONS}}}id")]
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    except (KeyError, IndexError):
        return "xl/worksheets/sheet1.xml"


def rows_of(data: bytes) -> Iterator[dict[int, str | None]]:
    """Each row of the first sheet: by column, the text of its cells (numbers as they are written, truth as true and false)."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, element in ElementTree.iterparse(part):
                    if _tag(element) == "si":
                        shared.append(_said(element))
                        element.clear()
        with book.open(_first_sheet(book)) as part:
            for _, element in ElementTree.iterparse(part):
                if _tag(element) != "row":
                    continue
                row, at = {}, -1
                for cell in element:
                    at = number(cell.get("r")) if cell.get("r") else at + 1
                    kind, inner = cell.get("t", "n"), {_tag(x): x for x in cell}
                    if kind == "inlineStr":
                        row[at] = _said(inner["is"]) if "is" in inner else None
                    elif "v" in inner and inner["v"].text is not None:
                        row[at] = _value(kind, inner["v"].text, shared)
                yield row
                element.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All .xlsx files of ``path``, with ``file_name``; columns by name, in the order in which they first stand.

    A column of numbers only is one of doubles, other columns are strings.  Names are looked up first, and a
    nameless column is left out; a file without rows gives none.  Of columns of one name in a file the last counts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names: dict[int, str] | None = None
                held: list[tuple[int, list]] = []
                for n, row in enumerate(rows_of(content.as_py())):
                    if names is None:
                        names = {c: v for c, v in row.items() if v}
                        held.append((-1, [(v, str(c)) for c, v in sorted(names.items())]))
                    elif row:
                        held.append((n, list({names[c]: v for c, v in sorted(row.items()) if c in names}.items())))
                    if len(held) == 4096:
                        yield _cells(place, held)
                        held = []
                if held:
                    yield _cells(place, held)

    cells = files.mapInArrow(take, "path string, n long, cells map<string,string>")
    heads = cells.where("n < 0").select("path", F.explode("cells").alias("name", "at"))
    order = heads.groupBy("name").agg(F.min(F.struct("path", F.col("at").cast("int"))).alias("first")).orderBy("first").select("name").collect()
    names = [r["name"] for r in order]
    rows = cells.where("n >= 0")
    odd = rows.agg(*(F.count(F.when(F.col("cells")[c].isNotNull() & F.col("cells")[c].try_cast("double").isNull(), 1)).alias(f"c{i}") for i, c in enumerate(names))).first() if names else None
    typed = [(F.col("cells")[c].try_cast("double") if odd[f"c{i}"] == 0 else F.col("cells")[c]).alias(c) for i, c in enumerate(names)]
    return rows.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("file_name"), *typed)


def _cells(place: str, held: list[tuple[int, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place] * len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([c for _, c in held], pa.map_(pa.string(), pa.string()))], names=["path", "n", "cells"])


class Sheet:
    """A file that is written row by row."""

    def __init__(self, path: str, names: list[str]):
        self.book = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        for name, text in PARTS.items():
            self.book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        self.part = self.book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.columns, self.n = [letters(i) for i in range(len(names))], 0
        self.add(names)

    def add(self, values) -> None:
        self.n += 1
        cells = "".join(self._cell(f"{c}{self.n}", v) for c, v in zip(self.columns, values) if v is not None)
        self.part.write(f'<row r="{self.n}">{cells}</row>'.encode("utf-8", "replace"))

    @staticmethod
    def _cell(at: str, v) -> str:
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.book.close()


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = folder, names, overwrite

    def write(self, rows) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        files, sheet = [], None
        for row in rows:
            if sheet is None or sheet.n == ROWS:
                if sheet is not None:
                    sheet.close()
                files.append(f"{self.folder}/.{uuid.uuid4().hex}.tmp")
                sheet = Sheet(files[-1], self.names)
            sheet.add(row)
        if sheet is not None:
            sheet.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = [f for f in os.listdir(self.folder) if f.endswith(".xlsx")]
        run, made = uuid.uuid4().hex[:12], [f for m in messages if m is not None for f in m.files]
        for i, f in enumerate(made):
            os.replace(f, f"{self.folder}/part-{i:05d}-{run}.xlsx")
        if not made:
            Sheet(f"{self.folder}/part-00000-{run}.xlsx", self.names).close()
        for f in old if self.overwrite else []:
            os.remove(f"{self.folder}/{f}")

    def abort(self, messages: list) -> None:
        for m in messages:
            for f in m.files if m is not None else []:
                if os.path.exists(f):
                    os.remove(f)


class Workbooks(DataSource):
    """``df.write.format("workbooks").mode(...).save(folder)``: .xlsx files in a folder that driver and executors all reach as a file path."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if (scheme := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)) and scheme[1] != "file":
            raise ValueError(f"workbooks are written to a mounted folder, not to {scheme[1]}:")
        if len(schema.names) > COLUMNS:
            raise ValueError(f"a sheet has {COLUMNS} columns at most")
        return _Writer(re.sub("^file:(//)?", "", path).rstrip("/"), schema.names, overwrite)


def write_workbooks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table as .xlsx files, one for each task that has rows (more for over a million); numbers and truth as such, all else as text.

    Overwriting puts the new files in place before the old ones go.
    """
    df.sparkSession.dataSource.register(Workbooks)
    plain = [F.col(f"`{f.name}`") if f.dataType.simpleString() in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]
    df.select(*plain).write.format("workbooks").mode(mode).save(path)
