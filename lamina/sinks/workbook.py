"""Workbook writer: the ordered rows of a document become one sheet of texts, header rows bold on grey."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STYLES = f'<styleSheet xmlns="{S}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFCCCCCC"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
_HIDDEN = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def column_name(n: int) -> str:
    """Letters of a column from 0."""
    name = ""
    while n >= 0:
        n, rest = divmod(n, 26)
        name, n = chr(65 + rest) + name, n - 1
    return name


def _cell(text: str) -> str:
    return escape(_HIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def workbook_bytes(rows: list[tuple[list[str], bool]], sheet: str = "Document", widest: int = 50) -> bytes:
    """A workbook of (cells, is header) rows; a column is as wide as its longest text plus two, at most ``widest``."""
    width: dict[int, int] = {}
    lines = []
    for i, (cells, header) in enumerate(rows, 1):
        own = []
        for j, text in enumerate(cells):
            width[j] = max(width.get(j, 0), len(text or ""))
            own.append(f'<c r="{column_name(j)}{i}" s="{int(header)}" t="inlineStr"><is><t xml:space="preserve">{_cell(text or "")}</t></is></c>')
        lines.append(f'<row r="{i}">{"".join(own)}</row>')
    columns = "".join(f'<col min="{j + 1}" max="{j + 1}" width="{min(w + 2, widest)}" customWidth="1"/>' for j, w in sorted(width.items()))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="{_cell(sheet[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": STYLES,
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), HEAD + data)
    return out.getvalue()


def sheet_rows(content: bytes) -> list[list[str]]:
    """The rows of the first sheet of a workbook of this writer."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml"))
    plain = re.compile(r"_x([0-9A-Fa-f]{4})_")
    return [[plain.sub(lambda m: chr(int(m[1], 16)), "".join(c.itertext())) for c in row] for row in root.iter(f"{{{S}}}row")]


def _line(row: Column, cells: Column, header: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), cells.alias("cells"), header.alias("header"))


def row_plan(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, row, cells, header) of elements (doc_id, seq, kind, text, row_idx, cells, is_header), where a table has a row each.

    A caption (row -1) comes before each table's rows; blank paragraphs go. The writer puts header rows before the others.
    """
    table, no = F.col("kind") == "table", F.lit(False)
    number = F.dense_rank().over(Window.partitionBy("doc_id", "kind").orderBy("seq"))
    caption = _line(F.lit(-1), F.array(F.concat(F.lit("Table "), F.col("_n").cast("string"))), no)
    own = _line(F.col("row_idx"), F.col("cells"), F.coalesce("is_header", no))
    plan = F.when(table & (F.col("row_idx") == 0), F.array(caption, own)).when(table, F.array(own)).otherwise(F.array(_line(F.lit(0), F.array(F.lit("Paragraph"), "text"), no)))
    return rows.filter(table | (F.trim("text") != "")).withColumn("_n", number).select("doc_id", "seq", F.inline(plan))


def write_workbooks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): one workbook a key from its rows (key, seq, row, cells, header); those of a key meet in one task."""
    own = F.sort_array(F.collect_list(F.struct("seq", (F.col("row") >= 0).alias("body"), (~F.coalesce("header", F.lit(False))).alias("plain"), "row", "cells"))).alias("rows")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [workbook_bytes([(list(r["cells"]), r["header"]) for r in rs]) for rs in pdf["rows"]]})

    lines = F.transform("rows", lambda r: F.struct(r["cells"].alias("cells"), (~r["plain"]).alias("header")))
    return rows.groupBy(key).agg(own).select(key, lines.alias("rows")).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, content binary")
