"""PDF writer: the placed lines of a document become the bytes of one file.

Text is set in the built-in Helvetica, in its Latin encoding. A line with other characters shows ``?`` for them and carries its real text
beside (ActualText), so that nothing is lost to search and copying. Fonts aren't embedded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina import scratch

A4 = (595.28, 841.89)


def _literal(data: bytes) -> bytes:
    data = re.sub(rb"([\\()])", rb"\\\1", data)
    return b"(" + data.replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def _shown(text: str) -> bytes:
    data = text.encode("cp1252", "replace")
    shown = _literal(data) + b" Tj"
    if data.decode("cp1252", "replace") == text:
        return shown
    return b"/Span <</ActualText <FEFF" + text.encode("utf-16-be").hex().upper().encode() + b">>> BDC " + shown + b" EMC"


def page_stream(lines: Iterable[dict], height: float) -> bytes:
    """Lines have x, y (of the base line, downwards from the top), size, bold and text."""
    out = []
    for line in lines:
        font = b"/F2" if line.get("bold") else b"/F1"
        out.append(b"BT %s %g Tf 1 0 0 1 %.2f %.2f Tm %s ET" % (font, line["size"], line["x"], height - line["y"], _shown(line["text"] or "")))
    return b"\n".join(out)


def pdf_bytes(pages: list[list[dict]], title: str = "", size: tuple[float, float] = A4) -> bytes:
    """One file of at least one page."""
    pages = pages or [[]]
    kids = [6 + 2 * i for i in range(len(pages))]
    objects = [
        b"<</Type /Catalog /Pages 2 0 R>>",
        b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids)),
        b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>",
        b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding>>",
        b"<</Title <FEFF" + title.encode("utf-16-be").hex().upper().encode() + b">>>",
    ]
    for kid, lines in zip(kids, pages, strict=True):
        stream = zlib.compress(page_stream(lines, size[1]))
        objects.append(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources <</Font <</F1 3 0 R /F2 4 0 R>>>> /Contents %d 0 R>>" % (*size, kid + 1))
        objects.append(b"<</Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream" % (len(stream), stream))
    out, offsets = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out += b"trailer\n<</Size %d /Root 1 0 R /Info 5 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


_OBJECT = re.compile(rb"<</Filter /FlateDecode /Length (\d+)>>\nstream\n")
_LINE = re.compile(rb"^BT .*? Tm (?:/Span <</ActualText <FEFF([0-9A-F]*)>>> BDC )?\(((?:[^\\()]|\\.)*)\) Tj", re.S | re.M)


def page_texts(content: bytes) -> list[list[str]]:
    """The lines of each page of a file of this writer, for round trips."""
    pages, at = [], 0
    while found := _OBJECT.search(content, at):
        at = found.end() + int(found[1])
        lines = []
        for actual, literal in _LINE.findall(zlib.decompress(content[found.end() : at])):
            plain = re.sub(rb"\\(.)", lambda m: {b"r": b"\r", b"n": b"\n"}.get(m[1], m[1]), literal)
            lines.append(bytes.fromhex(actual.decode()).decode("utf-16-be") if actual else plain.decode("cp1252"))
        pages.append(lines)
    return pages


def write_pdfs(lines: DataFrame, key: str, title: str | None = None, size: tuple[float, float] = A4) -> DataFrame:
    """(key, content): one file a key from its lines (key, page from 1, seq, x, y, size, bold, text); a page without lines before the last stays empty.

    A document's lines meet in one task. ``title`` names a column, constant within a key.
    """
    own = F.sort_array(F.collect_list(F.struct("page", "seq", "x", "y", "size", "bold", "text"))).alias("lines")
    named = F.coalesce(F.max(title), F.lit("")) if title else F.lit("")

    def file(k, rows, name):
        pages: list[list[dict]] = [[] for _ in range(max((r["page"] for r in rows), default=1))]
        for r in rows:
            pages[r["page"] - 1].append(r)
        return [(k, pdf_bytes(pages, name, size))]

    grouped = lines.groupBy(key).agg(own, named.alias("title"))
    return scratch.by_row(grouped.select(key, "lines", "title"), file, f"{key} {dict(lines.dtypes)[key]}, content binary")


def read_texts(files: DataFrame, key: str) -> DataFrame:
    """(key, pages): the lines of each page of files (key, content) of this writer."""
    return scratch.by_row(files.select(key, "content"), lambda k, content: [(k, page_texts(content))], f"{key} {dict(files.dtypes)[key]}, pages array<array<string>>")


def set_lines(rows: DataFrame, key: str = "doc_id", per_page: int = 50, margin: float = 72.0, size: float = 11.0) -> DataFrame:
    """Lines (key, seq, text) at fixed places, ``per_page`` on a page."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1
    placed = rows.select(key, "seq", F.coalesce("text", F.lit("")).alias("text"), at.alias("_at"))
    return placed.select(key, (F.floor(F.col("_at") / per_page) + 1).cast("int").alias("page"), "seq", F.lit(margin).alias("x"), (F.lit(margin) + (F.col("_at") % per_page + 1) * (size * 1.2)).alias("y"), F.lit(size).alias("size"), F.lit(False).alias("bold"), "text")
