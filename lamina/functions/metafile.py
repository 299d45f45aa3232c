"""Vector metafiles (EMF, WMF) as SVG.

One pass over the records keeps the drawing state: pens, brushes, fonts, position, window. Records without a rule are skipped, a record that
is cut off ends the picture. Bitmaps inside metafiles are not drawn, and nothing is rasterised.
"""

from __future__ import annotations

import struct
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Pen styles that draw a dashed line, and stock objects (white, black, none), by their numbers in the formats.
DASHES = {1: "6 3", 2: "2 2", 3: "6 3 2 3", 4: "6 3 2 3 2 3"}
STOCK = {0: ("brush", "#FFFFFF"), 4: ("brush", "#000000"), 5: ("brush", "none"), 6: ("pen", ("#FFFFFF", 1, None)), 7: ("pen", ("#000000", 1, None)), 8: ("pen", ("none", 1, None))}


def _color(value: int) -> str:
    return f"#{value & 255:02X}{value >> 8 & 255:02X}{value >> 16 & 255:02X}"


def _points(data: bytes, at: int, n: int, form: str) -> list[tuple[int, int]]:
    size = struct.calcsize(form)
    if n < 0 or at + 2 * n * size > len(data):
        raise struct.error
    flat = struct.unpack_from(f"<{2 * n}{form}", data, at)
    return list(zip(flat[::2], flat[1::2], strict=True))


class _Canvas:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.pen, self.brush, self.font = ("#000000", 1, None), "#FFFFFF", ("sans-serif", 12)
        self.text, self.at, self.origin, self.extent = "#000000", (0, 0), (0, 0), None
        self.objects: dict[int, tuple] = {}
        self.saved: list[tuple] = []
        self.path: list[str] | None = None

    def save(self) -> None:
        self.saved.append((self.pen, self.brush, self.font, self.text, self.at, self.origin, self.extent))

    def restore(self) -> None:
        if self.saved:
            self.pen, self.brush, self.font, self.text, self.at, self.origin, self.extent = self.saved.pop()

    def select(self, handle: int) -> None:
        kind, value = STOCK.get(handle & 0x7FFFFFFF, (None, None)) if handle & 0x80000000 else self.objects.get(handle, (None, None))
        if kind:
            setattr(self, kind, value)

    def free(self) -> int:
        return next(i for i in range(len(self.objects) + 1) if i not in self.objects)

    def _style(self, fill: bool, stroke: bool = True) -> str:
        color, width, dash = self.pen if stroke else ("none", 1, None)
        dashes = f' stroke-dasharray="{dash}"' if dash else ""
        return f'fill="{self.brush if fill else "none"}" stroke="{color}" stroke-width="{max(width, 1)}"{dashes}'

    def shape(self, tag: str, fill: bool, **attributes: float) -> None:
        own = " ".join(f'{k}="{v:g}"' for k, v in attributes.items())
        self.out.append(f"<{tag} {own} {self._style(fill)}/>")

    def draw(self, commands: str, fill: bool) -> None:
        if self.path is not None:
            self.path.append(commands)
        else:
            self.out.append(f'<path d="{commands}" {self._style(fill)}/>')

    def line(self, points: list[tuple[int, int]], closed: bool = False, curve: bool = False, start: bool = True) -> None:
        """Through points; ``start`` begins at the first of them, else at the position, which then follows."""
        if not points:
            return
        if start:
            head, points = points[0], points[1:]
        else:
            head, self.at = self.at, points[-1]
        move = "" if not start and self.path else f"M{head[0]},{head[1]}"
        self.draw(move + ("C" if curve else "L") + " ".join(f"{x},{y}" for x, y in points) + ("Z" if closed else ""), closed)

    def finish(self, fill: bool, stroke: bool) -> None:
        if self.path:
            self.out.append(f'<path d="{"".join(self.path)}" {self._style(fill, stroke)}/>')
        self.path = None

    def box(self, tag: str, left: int, top: int, right: int, bottom: int) -> None:
        if tag == "ellipse":
            self.shape(tag, True, cx=(left + right) / 2, cy=(top + bottom) / 2, rx=abs(right - left) / 2, ry=abs(bottom - top) / 2)
        else:
            self.shape(tag, True, x=min(left, right), y=min(top, bottom), width=abs(right - left), height=abs(bottom - top))

    def write(self, x: int, y: int, text: str) -> None:
        clean = "".join(c for c in text if c >= " " or c == "\t")
        self.out.append(f'<text x="{x}" y="{y}" font-family="{escape(self.font[0], {chr(34): "&quot;"})}" font-size="{self.font[1]}" fill="{self.text}">{escape(clean)}</text>')

    def svg(self, box: tuple[int, int, int, int]) -> str:
        if self.extent and all(self.extent):
            box = (*self.origin, abs(self.extent[0]), abs(self.extent[1]))
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{box[0]} {box[1]} {box[2]} {box[3]}">{"".join(self.out)}</svg>'


def _emf_record(c: _Canvas, kind: int, d: bytes) -> None:
    """``d`` is the record behind its type and size."""
    ints = lambda at, n: struct.unpack_from(f"<{n}i", d, at)
    long, short = {2: (True, False), 3: (False, True), 4: (False, False)}, {85: (True, False), 86: (False, True), 87: (False, False)}
    if kind in long or kind in short:
        curve, closed = (long | short)[kind]
        c.line(_points(d, 20, ints(16, 1)[0], "i" if kind in long else "h"), closed, curve)
    elif kind in (5, 6, 88, 89):
        c.line(_points(d, 20, ints(16, 1)[0], "i" if kind < 10 else "h"), curve=kind in (5, 88), start=False)
    elif kind in (7, 8, 90, 91):
        n, form = ints(16, 1)[0], "i" if kind < 10 else "h"
        at = 24 + 4 * n
        for size in ints(24, n):
            c.line(_points(d, at, size, form), closed=kind in (8, 91))
            at += 2 * size * struct.calcsize(form)
    elif kind == 9:
        c.extent = ints(0, 2)
    elif kind == 10:
        c.origin = ints(0, 2)
    elif kind == 24:
        c.text = _color(struct.unpack_from("<I", d)[0])
    elif kind == 27:
        c.at = ints(0, 2)
        if c.path is not None:
            c.path.append(f"M{c.at[0]},{c.at[1]}")
    elif kind == 54:
        c.line([ints(0, 2)], start=False)
    elif kind in (42, 43, 44):
        c.box("ellipse" if kind == 42 else "rect", *ints(0, 4))
    elif kind == 33:
        c.save()
    elif kind == 34:
        c.restore()
    elif kind == 37:
        c.select(struct.unpack_from("<I", d)[0])
    elif kind == 38:
        handle, style, width, _, color = struct.unpack_from("<IIiiI", d)
        c.objects[handle] = ("pen", ("none" if style & 15 == 5 else _color(color), width, DASHES.get(style & 15)))
    elif kind == 95:
        handle, _, _, _, _, style, width, _, color = struct.unpack_from("<9I", d)
        c.objects[handle] = ("pen", ("none" if style & 15 == 5 else _color(color), width, DASHES.get(style & 15)))
    elif kind == 39:
        handle, style, color = struct.unpack_from("<III", d)
        c.objects[handle] = ("brush", "none" if style == 1 else _color(color))
    elif kind == 82:
        handle, height = struct.unpack_from("<Ii", d)
        name = d[32:96].decode("utf-16-le", "replace").partition("\0")[0]
        c.objects[handle] = ("font", (name or "sans-serif", abs(height) or 12))
    elif kind == 40:
        c.objects.pop(struct.unpack_from("<I", d)[0], None)
    elif kind in (83, 84):
        x, y, n, at = struct.unpack_from("<iiII", d, 28)
        width = kind - 82
        c.write(x, y, d[at - 8 : at - 8 + n * width].decode("utf-16-le" if width == 2 else "cp1252", "replace"))
    elif kind == 59:
        c.path = []
    elif kind == 61 and c.path is not None:
        c.path.append("Z")
    elif kind in (62, 63, 64):
        c.finish(kind != 64, kind != 62)


def _wmf_record(c: _Canvas, kind: int, d: bytes) -> None:
    """``d`` is the record behind its size and function. Most parameters are stored last first."""
    shorts = lambda n: struct.unpack_from(f"<{n}h", d)
    if kind in (0x020B, 0x020C, 0x0214):
        y, x = shorts(2)
        setattr(c, {0x020B: "origin", 0x020C: "extent", 0x0214: "at"}[kind], (x, y))
    elif kind == 0x0213:
        c.line([shorts(2)[::-1]], start=False)
    elif kind in (0x041B, 0x0418):
        bottom, right, top, left = shorts(4)
        c.box("ellipse" if kind == 0x0418 else "rect", left, top, right, bottom)
    elif kind in (0x0324, 0x0325):
        c.line(_points(d, 2, shorts(1)[0], "h"), closed=kind == 0x0324)
    elif kind == 0x02FA:
        style, width, _, color = struct.unpack_from("<HhhI", d)
        c.objects[c.free()] = ("pen", ("none" if style & 15 == 5 else _color(color), width, DASHES.get(style & 15)))
    elif kind == 0x02FC:
        style, color = struct.unpack_from("<HI", d)
        c.objects[c.free()] = ("brush", "none" if style == 1 else _color(color))
    elif kind == 0x02FB:
        c.objects[c.free()] = ("font", (d[18:50].partition(b"\0")[0].decode("cp1252", "replace") or "sans-serif", abs(shorts(1)[0]) or 12))
    elif kind == 0x012D:
        c.select(struct.unpack_from("<H", d)[0])
    elif kind == 0x01F0:
        c.objects.pop(struct.unpack_from("<H", d)[0], None)
    elif kind == 0x0209:
        c.text = _color(struct.unpack_from("<I", d)[0])
    elif kind == 0x0521:
        n = shorts(1)[0]
        y, x = struct.unpack_from("<hh", d, 2 + n + n % 2)
        c.write(x, y, d[2 : 2 + n].decode("cp1252", "replace"))
    elif kind == 0x001E:
        c.save()
    elif kind == 0x0127:
        c.restore()


def to_svg(content: bytes | None) -> str | None:
    """The picture as SVG; null for bytes that are no metafile."""
    data = bytes(content or b"")
    c = _Canvas()
    if data[40:44] == b" EMF" and data[:4] == b"\x01\0\0\0":
        left, top, right, bottom = struct.unpack_from("<4i", data, 8)
        at, head, box = struct.unpack_from("<I", data, 4)[0], "<II", (left, top, max(right - left, 1), max(bottom - top, 1))
    elif data[:4] == b"\xd7\xcd\xc6\x9a" and len(data) >= 40:
        left, top, right, bottom = struct.unpack_from("<4h", data, 6)
        at, head, box = 40, "<IH", (left, top, max(right - left, 1), max(bottom - top, 1))
    else:
        return None
    emf = head == "<II"
    while at + struct.calcsize(head) <= len(data):
        first, second = struct.unpack_from(head, data, at)
        kind, size = (first, second) if emf else (second, 2 * first)
        if size < struct.calcsize(head) or at + size > len(data) or kind == (14 if emf else 0):
            break
        try:
            (_emf_record if emf else _wmf_record)(c, kind, data[at + struct.calcsize(head) : at + size])
        except struct.error:
            break
        at += size
    return c.svg(box)


@F.pandas_udf(StringType())
def svg(content: pd.Series) -> pd.Series:
    return content.map(to_svg)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, BMP, JPEG and EMF pictures; null for others and broken ones."""
    data = bytes(content or b"")
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    if data[:2] == b"\xff\xd8":
        return _jpeg_size(data)
    if data[40:44] == b" EMF":
        left, top, right, bottom = struct.unpack_from("<4i", data, 8)
        return right - left, bottom - top
    return None


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def image_info(content: pd.Series) -> pd.DataFrame:
    sizes = [image_size(c) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")
