"""HTML scan: a page is one row in, its paragraphs and tables are rows out, in document order."""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import scratch

SCHEMA = "seq int, kind string, text string, list_level int, list_format string, table_seq int, row_idx int, col_idx int, is_header boolean, src string, rel_id string, runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,color:string,font_size:string,font_name:string>>"
MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline"}


class PageScanner(HTMLParser):
    """Emits rows. Only p, ul, ol, li, table, tr, td, th, img and inline marks have rules; text anywhere else still counts.

    An open paragraph ends with its text when its own end tag comes. If another block opens first, or the page ends, it keeps the runs closed so far but
    its text stays empty. Text outside any paragraph opens one without numbering. After an inner list closes, the outer one keeps the inner's level.
    A table within a cell is a table of its own (a further table_seq); its cells come before the outer cell, which keeps all its own text around it.
    """

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.level, self.format = 0, None
        self.open: dict | None = None
        self.run: dict | None = None
        self.styles: list[dict] = []
        self.tables = -1
        self.cell: dict | None = None
        self.row_idx = self.col_idx = -1
        self.in_table = False
        self.table_seq, self.outer = -1, []

    def emit(self, kind: str, **fields) -> None:
        self.rows.append({"seq": len(self.rows), "kind": kind} | fields)

    def shut(self, whole: bool) -> None:
        """Ends the open paragraph; ``whole``: by its own end tag."""
        if self.open is None:
            return
        if whole:
            self.flush()
        paragraph, self.open, self.run = self.open, None, None
        text = "".join(r["text"] for r in paragraph["runs"]) if whole else ""
        if self.cell is not None:
            self.cell["texts"].append(text)
        else:
            self.emit("paragraph", text=text, runs=paragraph["runs"], list_level=paragraph["level"], list_format=paragraph["format"])

    def flush(self) -> None:
        if self.run and self.run["text"]:
            self.open["runs"].append(self.run)
        self.run = None

    def begin(self, level=None, form=None) -> None:
        self.open, self.run, self.styles = {"runs": [], "level": level, "format": form}, None, []

    def handle_starttag(self, tag, attrs):
        own = {k.lower(): v for k, v in attrs}
        if tag == "p":
            self.shut(False)
            self.begin()
        elif tag in ("ul", "ol"):
            self.level += 1
            self.format = "bullet" if tag == "ul" else "decimal"
        elif tag == "li":
            self.shut(False)
            self.begin(self.level - 1 if self.format else None, self.format)
        elif tag == "table":
            self.shut(self.cell is not None)
            self.outer.append((self.table_seq, self.row_idx, self.col_idx, self.cell, self.in_table))
            self.tables += 1
            self.table_seq, self.in_table, self.row_idx, self.cell = self.tables, True, -1, None
        elif tag == "tr" and self.in_table:
            self.row_idx += 1
            self.col_idx = -1
        elif tag in ("td", "th") and self.in_table:
            self.col_idx += 1
            self.cell = {"texts": [], "header": tag == "th"}
            self.begin()
        elif tag == "img":
            self.shut(False)
            src = own.get("src") or ""
            self.emit("image", text=own.get("alt") or "", src=src, rel_id=own.get("data-image-id") or hashlib.md5(src.encode()).hexdigest()[:8])
        elif tag in MARKS or tag in ("span", "font"):
            if self.open is not None:
                self.flush()
            style = dict(self.styles[-1]) if self.styles else {}
            if tag in MARKS:
                style[MARKS[tag]] = True
            style |= css(own.get("style") or "")
            if own.get("color"):
                style["color"] = own["color"]
            self.styles.append(style)

    def handle_endtag(self, tag):
        if tag in ("p", "li"):
            self.shut(True)
        elif tag in ("ul", "ol"):
            self.level = max(0, self.level - 1)
            self.format = self.format if self.level else None
        elif tag in ("td", "th") and self.cell is not None:
            self.shut(True)
            cell, self.cell = self.cell, None
            self.emit("cell", text="\n".join(t for t in cell["texts"] if t), table_seq=self.table_seq, row_idx=self.row_idx, col_idx=self.col_idx, is_header=cell["header"])
        elif tag == "table" and self.outer:
            self.shut(False)
            self.table_seq, self.row_idx, self.col_idx, self.cell, self.in_table = self.outer.pop()
        elif (tag in MARKS or tag in ("span", "font")) and self.styles:
            if self.open is not None:
                self.flush()
            self.styles.pop()

    def handle_data(self, data):
        if self.open is None:
            if not data.strip():
                return
            self.begin()
        if self.run is None:
            style = self.styles[-1] if self.styles else {}
            self.run = {"text": ""} | {k: bool(style.get(k)) for k in ("bold", "italic", "underline")} | {k: style.get(k) for k in ("color", "font_size", "font_name")}
        self.run["text"] += data

    def close(self):
        super().close()
        self.shut(False)


def css(style: str) -> dict:
    out = {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "color":
            out["color"] = value
        elif name == "font-size":
            out["font_size"] = value
        elif name == "font-family":
            out["font_name"] = value.split(",")[0].strip().strip("'\"")
    return out


def scan(html: str | None) -> list[dict]:
    """Rows of one page; a page that can't be scanned has none."""
    scanner = PageScanner()
    try:
        scanner.feed(html or "")
        scanner.close()
    except Exception:  # noqa: BLE001  any broken page counts as empty
        return []
    return scanner.rows


def scan_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row an element of each page, with its key. A page never leaves its task: no shuffle."""
    kind = dict(pages.dtypes)[key]
    names = [part.split(" ")[0] for part in ("seq int", "kind string", "text string", "list_level int", "list_format string", "table_seq int", "row_idx int", "col_idx int", "is_header boolean", "src string", "rel_id string", "runs array")]

    return scratch.by_row(pages.select(key, html), lambda k, h: ((k, *map(r.get, names)) for r in scan(h)), f"{key} {kind}, {SCHEMA}")


def read_pages(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """(key, html) of HTML files, one row a file; a path where nothing is gives no rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], f"{key} string, html string")
    return files.select(F.col("_metadata.file_path").alias(key), F.col("value").alias("html"))
