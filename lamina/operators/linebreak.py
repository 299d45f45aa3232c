"""Lines of texts of a given width: greedy breaking by the widths of characters, with the places of every line.

Widths are whole thousandths of the font's size, so sums are exact. A text's words are placed once on a line without end (running sums); where a line breaks is a search in these sums,
so work grows with the words and no text grows word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "array<struct<line:int,first:int,last:int,start:int,end:int,units:long,text:string>>"
#: The width of a character that a font doesn't name, in thousandths of its size.
USUAL = 600


def widths_of(font: dict[str, int], usual: int = USUAL) -> np.ndarray:
    """A table of widths by code point, for the characters of the first plane."""
    table = np.full(1 << 16, usual, np.int64)
    for c, w in font.items():
        table[ord(c)] = w
    return table


def break_words(text: str, table: np.ndarray, limit: int, trailing: bool) -> list[dict]:
    """The lines of one text. ``trailing``: a line's last blank counts too."""
    spans = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
    if not len(spans):
        return [{"line": 0, "first": 0, "last": -1, "start": 0, "end": 0, "units": 0, "text": ""}]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    along = np.r_[0, np.cumsum(table[np.minimum(codes, len(table) - 1)])]
    blank = int(table[32])
    ends = np.r_[0, np.cumsum(along[spans[:, 1]] - along[spans[:, 0]] + blank)]  # where each word would begin
    room = limit if trailing else limit + blank
    out, at = [], 0
    while at < len(spans):
        behind = max(at + 1, int(np.searchsorted(ends, ends[at] + room, side="right")) - 1)
        words = [text[a:b] for a, b in spans[at:behind]]
        out.append({"line": len(out), "first": at, "last": behind - 1, "start": int(spans[at, 0]), "end": int(spans[behind - 1, 1]), "units": int(ends[behind] - ends[at]) - (0 if trailing else blank), "text": " ".join(words)})
        at = behind
    return out


def lines_of(rows: DataFrame, table: np.ndarray, limit: int, trailing: bool, text: str) -> DataFrame:
    @F.pandas_udf(LINES)
    def lines(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else break_words(t, table, limit, trailing) for t in texts], dtype=object)

    return rows.select(*(c for c in rows.columns if c != text), F.inline(lines(F.col(text))))


def broken(rows: DataFrame, width: float, size: float, font: dict[str, int] | None = None, text: str = "text") -> DataFrame:
    """A row for each line of each row, in ``width`` points at ``size`` with the widths of ``font`` (character -> thousandths): line (from 0), first and last (places of its
    words), start and end (places in the text, end exclusive), width in points, text.

    A word that is wider than the line has one of its own. A text without words is one empty line, null has none. Other columns stay.
    """
    found = lines_of(rows, widths_of(font or {}), int(width * 1000 / size + 1e-6), False, text)
    return found.withColumn("width", F.col("units") * size / 1000).drop("units")


def broken_by_length(rows: DataFrame, width: float, size: float, text: str = "text") -> DataFrame:
    """The rule without a font: every word costs its length and a blank, and a line has room for as many characters as 0.6 of the size allow, one at least."""
    return lines_of(rows, widths_of({}, 1), max(1, int(width / (0.6 * size))), True, text).drop("units")
