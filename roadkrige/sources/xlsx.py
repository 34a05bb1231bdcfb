"""Workbooks: a reader over Spark's binary files and a writer of one small file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, clean_text, extract_latlon
from ..operators.relational import forward_fill
from .files import bounded_rows, write_bytes

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Layout of the count workbooks.
HEADER_ROW, NAME_COLUMN, PLACE_COLUMN = 3, 2, 13
COUNT_HEADER = "แต่ละถนน"


def _column(ref: str) -> int:
    out = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        out = out * 26 + ord(ch) - 64
    return out - 1


def parse(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first by default) as texts, gaps as None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        chosen = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}")
        target = links[chosen.get(_LINK)].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        number = 0
        for row in ElementTree.fromstring(z.read(target)).iter(f"{_MAIN}row"):
            at = int(row.get("r", number + 1))
            while number < at - 1:
                number += 1
                yield []
            number = at
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[i] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[i] = shared[int(v.text)] if kind == "s" else v.text
            yield cells


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, malformed: str = "FAILFAST") -> DataFrame:
    """file, rownum (0-based) and cells of every row; DROPMALFORMED skips files that cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = list(parse(content, sheet))
                except Exception:
                    if malformed == "DROPMALFORMED":
                        continue
                    raise
                yield pd.DataFrame({"path": name, "rownum": range(len(rows)), "cells": rows})

    rows = files.mapInPandas(run, "path string, rownum long, cells array<string>")
    return rows.select(base_name(F.col("path")).alias("file"), "rownum", "cells")


def with_header(rows: DataFrame, header: int = 0) -> DataFrame:
    """Columns named by the header row of the first file, below it one row per data row."""
    first = rows.filter(F.col("rownum") == header).orderBy("file").first()
    names = [n if n else f"_c{i}" for i, n in enumerate(first["cells"])] if first else []
    cells = [F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return rows.filter(F.col("rownum") > header).select("file", "rownum", *cells)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Traffic counts of a folder of workbooks: file, road_name, aadt, coords_lat, coords_lon.

    Merged cells are filled downwards before rows without a count are dropped;
    workbooks that cannot be read are skipped.
    """
    rows = read_xlsx(spark, path, malformed="DROPMALFORMED")
    head = rows.filter(F.col("rownum") == HEADER_ROW).select(F.col("file").alias("_file"), F.array_position("cells", COUNT_HEADER).cast("int").alias("_at"))
    body = rows.filter(F.col("rownum") > HEADER_ROW).join(head, F.col("file") == F.col("_file")).filter("_at > 0")
    cell = lambda i: F.try_element_at("cells", F.lit(i + 1))
    table = body.select("file", "rownum", cell(NAME_COLUMN).alias("road_name"), cell(PLACE_COLUMN).alias("latlon"), F.try_element_at("cells", F.col("_at")).alias("aadt"))
    filled = forward_fill(table, ["road_name", "latlon"], "rownum", "file").filter("aadt is not null")
    out = filled.select("file", clean_text(F.col("road_name")).alias("road_name"), F.col("aadt").try_cast("double").alias("aadt"), extract_latlon(F.col("latlon")).alias("p"))
    return out.select("file", "road_name", "aadt", F.col("p.lat").alias("coords_lat"), F.col("p.lon").alias("coords_lon")).filter("coords_lat is not null and coords_lon is not null")


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A minimal workbook of one sheet."""
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            ref = f"{_letters(i)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    main, rel = _MAIN[1:-1], "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    rows = bounded_rows(df)
    write_bytes(df.sparkSession, path, workbook([df.columns, *[list(r) for r in rows]], sheet))
