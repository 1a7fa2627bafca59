"""Spreadsheets: read whole, and written as one file for each partition by a data source of their own."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a sheet at most, and names of the format's parts.
MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Cell styles in order: general, text, date and time.
GENERAL, TEXT, TIME = range(3)
STYLES = (
    f'{HEAD}<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="YYYY-MM-DD HH:MM:SS"/></numFmts>'
    '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="49" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>'
)
EPOCH = datetime.datetime(1899, 12, 30)
#: Characters that XML can't hold.
BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def letters(n: int) -> str:
    """The name of column n, counting from 0."""
    name, n = "", n + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def cell(at: str, value, text: bool) -> str:
    """A cell's markup; nothing for null."""
    if value is None:
        return ""
    if isinstance(value, (datetime.datetime, datetime.date)) and not text:
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
        return f'<c r="{at}" s="{TIME}"><v>{(moment.replace(tzinfo=None) - EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(value, bool) and not text:
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and not text and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    shown = escape(BARRED.sub("", str(value)))
    return f'<c r="{at}" s="{TEXT if text else GENERAL}" t="inlineStr"><is><t xml:space="preserve">{shown}</t></is></c>'


def workbook(names: list[str], rows: Iterator, sheet: str = "Sheet1", text: tuple[str, ...] = ()) -> bytes:
    """A workbook of one sheet with a header; the columns in text are written as text, whatever they hold."""
    as_text = [n in text for n in names]
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
            z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{RELS}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", STYLES)
            with z.open("xl/worksheets/sheet1.xml", "w") as s:
                s.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                s.write(f'<row r="1">{"".join(cell(f"{letters(c)}1", n, True) for c, n in enumerate(names))}</row>'.encode())
                for r, row in enumerate(rows, 2):
                    if r > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most: repartition the rows")
                    s.write(f'<row r="{r}">{"".join(cell(f"{letters(c)}{r}", v, as_text[c]) for c, v in enumerate(row))}</row>'.encode())
                s.write(b"</sheetData></worksheet>")
        return out.getvalue()


def cells_of(raw: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as text; cells and rows that are left out are null and empty."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{MAIN}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = next(book.iter(f"{{{MAIN}}}sheet")).get(f"{{{RELS}}}id")
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == first)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as s:
            for _, row in ElementTree.iterparse(s):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                made: list[str | None] = []
                for c in row.iter(f"{{{MAIN}}}c"):
                    name = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(name[0]))) - 1 if name else len(made)
                    made += [None] * (at + 1 - len(made))
                    if c.get("t") == "inlineStr":
                        made[at] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
                    elif (v := c.find(f"{{{MAIN}}}v")) is not None:
                        made[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield made
                row.clear()


def read_xlsx(spark: SparkSession, path: str, *needed: str) -> DataFrame:
    """The first sheet of a workbook as text, its first row being the header, and ord, the row's place. Raises without the needed columns."""
    from tallyloom.sources.stock import required

    def run(batches):
        for files in batches:
            for raw in files["content"]:
                rows = list(cells_of(bytes(raw)))
                yield pd.DataFrame({"ord": range(len(rows)), "cells": rows})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ord long, cells array<string>")
    head = rows.where("ord = 0").first()
    names = [n if n is not None else f"column_{k + 1}" for k, n in enumerate(head["cells"])] if head else []
    required(names, *needed)
    return rows.where("ord > 0").select("ord", *[F.get("cells", k).alias(n) for k, n in enumerate(names)])


class XlsxDataSource(DataSource):
    """Write only, to a folder: `df.write.format("xlsx").option("sheet", ...).option("text", "a,b").mode("append").save(path)`."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema, overwrite):
        return XlsxWriter(schema.names, dict(self.options))


class XlsxWriter(DataSourceWriter):
    """One workbook for each partition, in a folder that all executors and readers see, by any URI that pyarrow's file systems know."""

    def __init__(self, names: list[str], options: dict[str, str]):
        self.names, self.path = names, options["path"]
        self.sheet, self.text = options.get("sheet", "Sheet1"), tuple(options.get("text", "").split(","))

    def write(self, iterator) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        raw = workbook(self.names, iter(iterator), self.sheet, self.text)
        where, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        where.create_dir(folder)
        # an attempt that fails leaves nothing under this name, and one that runs again writes the same
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.xlsx"
        with where.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}.tmp") as out:
            out.write(raw)
        where.move(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", name)
        return WriterCommitMessage()


def write_xlsx(rows: DataFrame, path: str, sheet: str = "Sheet1", text: tuple[str, ...] = (), files: int = 1) -> None:
    """rows in `files` workbooks in the folder path, their order kept if it is one; a sheet holds MOST_ROWS rows at most."""
    rows.sparkSession.dataSource.register(XlsxDataSource)
    rows.coalesce(files).write.format("xlsx").option("sheet", sheet).option("text", ",".join(text)).mode("append").save(path)
