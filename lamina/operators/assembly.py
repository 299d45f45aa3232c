"""Assembly of pages: blocks of lines flow over pages with spacing, forced breaks, split paragraphs and tables, and room for notes."""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina import scratch
from lamina.functions import text as T

BLOCK = ("seq", "kind", "lines", "line_h", "before", "after", "break_before", "break_after", "keep", "notes_h")
EPSILON = 1e-6


def fitting(lines: int, start: int, line_h: float, room: float, keep: bool, least: int) -> int:
    """How many lines from ``start`` on go into the room: all, or so many that at least ``least`` stay on both sides, else none."""
    rest = lines - start
    if rest * line_h <= room + EPSILON:
        return rest
    if keep or line_h <= 0:
        return 0
    here = min(math.floor((room + EPSILON) / line_h), rest - 1)
    here -= max(least - (rest - here), 0)
    return here if here >= least else 0


def assemble(blocks: list[dict], usable: float, least: int = 2, notes_counted: int = 2) -> list[dict]:
    """Places the ordered blocks of one document; see ``assembled``."""
    page, y, pending, notes, used, out = 1, 0.0, 0.0, 0.0, False, []
    forced = False
    for b in sorted(blocks, key=lambda b: b["kind"] == "endnote"):
        lines, line_h, least_here = max(int(b["lines"] or 0), 1), float(b["line_h"] or 0), 1 if b["kind"] == "table" else least
        if used and (forced or b["break_before"]):
            page, y, pending, notes, used = page + 1, 0.0, 0.0, 0.0, False
        start = 0
        while start < lines:
            gap = max(pending, float(b["before"] or 0)) if used and not start else 0.0
            own_notes = float(b["notes_h"] or 0) if not start else 0.0
            room = usable - y - gap - (notes + own_notes) * notes_counted
            n = fitting(lines, start, line_h, room, bool(b["keep"]) or b["kind"] == "image", least_here)
            if n == 0 and used:  # a block that fits no empty page either is cut there by force
                page, y, pending, notes, used = page + 1, 0.0, 0.0, 0.0, False
                continue
            if n == 0:
                n = lines - start if b["kind"] == "image" or line_h <= 0 else max(min(math.floor((room + EPSILON) / line_h), lines - start), 1)
            out.append({"seq": b["seq"], "page": page, "first_line": start, "n_lines": n, "y": y + gap, "h": n * line_h})
            y, notes, used, start = y + gap + n * line_h, notes + own_notes, True, start + n
            if start < lines:
                page, y, pending, notes, used = page + 1, 0.0, 0.0, 0.0, False
        pending, forced = float(b["after"] or 0), bool(b["break_after"])
    return out


def assembled(blocks: DataFrame, usable: float = 697.9, least: int = 2, notes_counted: int = 2) -> DataFrame:
    """(doc_id, seq, page, first_line, n_lines, y, h): one row a piece of a block on a page, y from the top of the body.

    Blocks are (doc_id, seq, kind, lines, line_h, before, after, break_before, break_after, keep, notes_h). The gap between two blocks is the larger
    of what they ask for; none opens a page. Paragraphs break with ``least`` lines on both sides, tables between rows, images and kept
    blocks not at all, unless they fit no page. Notes of a block take room on the page of its first piece, ``notes_counted`` times (the
    usual layout counts them twice). Endnotes come last. Nulls count as zero or false; a block has a line at least.

    An ordered fold: the measures of a document meet in one task, its texts don't.
    """
    own = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*BLOCK))).alias("blocks"))
    types = dict(blocks.dtypes)

    def run(batches):
        for pdf in batches:
            rows = [{"doc_id": k} | r for k, bs in zip(pdf["doc_id"], pdf["blocks"], strict=True) for r in assemble(list(bs), usable, least, notes_counted)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "page", "first_line", "n_lines", "y", "h"])

    return own.mapInPandas(run, f"doc_id {types['doc_id']}, seq {types['seq']}, page int, first_line int, n_lines int, y double, h double")


def measured(rows: DataFrame, table_rows: str | None = None, width: float = 451.3, size: float = 11.0) -> DataFrame:
    """Blocks for ``assembled`` from (doc_id, seq, kind, text): lines of paragraphs by the plain width rule, rows of tables from a column (else one)."""
    rows_of = F.col(table_rows).cast("int") if table_rows else F.lit(1)
    lines = F.when(F.col("kind") == "paragraph", F.greatest(F.expr(T.metric_lines("text", width, size)).cast("int"), F.lit(1))).when(F.col("kind") == "table", rows_of).otherwise(1)
    none = F.lit(0.0)
    return rows.select("doc_id", "seq", "kind", lines.alias("lines"), F.when(F.col("kind") == "image", 50.0).otherwise(size * 1.2).alias("line_h"), none.alias("before"), F.lit(6.0).alias("after"), F.lit(False).alias("break_before"), (F.col("kind") == "page_break").alias("break_after"), F.lit(False).alias("keep"), none.alias("notes_h"))


#: Rows of a batch that leaves Python.
ROWS = 10000
NOTED = ("seq", "kind", "lines", "line_h", "before", "after", "break_before", "break_after", "keep", "notes")


def fitting_noted(start: int, lines: int, line_h: float, room: float, notes: list[float], counted: int, gap: float, keep: bool, least: int) -> int:
    """How many lines from ``start`` on fit, when each brings its notes (their height by line) that take from the same room, and the first notes a ``gap``: all, or so many that
    ``least`` stay on both sides."""
    n, used = 0, 0.0
    while start + n < lines:
        used += line_h + counted * notes[start + n]
        if notes[start + n] and gap:
            used, gap = used + counted * gap, 0.0
        if used > room + EPSILON:
            break
        n += 1
    if start + n == lines:
        return n
    if keep:
        return 0
    n -= max(least - (lines - start - n), 0)
    return n if n >= least else 0


def assemble_noted(blocks: list[dict], usable: float, least: int, counted: int, note_gap: float) -> list[dict]:
    """Pieces of body blocks and the notes of their lines, on pages; see ``whole_pages``."""
    out: list[dict] = []
    page, y, pending, area, used, forced = 1, 0.0, 0.0, 0.0, False, False
    waiting: list[tuple[int, str, float]] = []  # notes of this page, in order

    def turn() -> None:
        nonlocal page, y, pending, area, used, waiting
        at = usable - sum(h for _, _, h in waiting)
        for seq, note, h in waiting:
            out.append({"seq": seq, "kind": "footnote", "note": note, "page": page, "first_line": 0, "n_lines": 1, "y": at, "h": h})
            at += h
        page, y, pending, area, used, waiting = page + 1, 0.0, 0.0, 0.0, False, []

    for b in blocks:
        lines, line_h = max(int(b["lines"] or 0), 1), float(b["line_h"] or 0)
        own = [[] for _ in range(lines)]
        for x in sorted(b["notes"] if b["notes"] is not None else (), key=lambda x: x["line"]):
            own[min(max(int(x["line"]), 0), lines - 1)].append((x["id"], float(x["h"])))
        heights = [sum(h for _, h in line) for line in own]
        few = 1 if b["kind"] == "table" else least
        if used and (forced or b["break_before"]):
            turn()
        start = 0
        while start < lines:
            gap = max(pending, float(b["before"] or 0)) if used and not start else 0.0
            room = usable - y - gap - counted * area
            first = 0.0 if area else note_gap
            n = fitting_noted(start, lines, line_h, room, heights, counted, first, bool(b["keep"]) or b["kind"] == "image", few)
            if n == 0 and used:
                turn()
                continue
            if n == 0:  # it fits no empty page either: as much as goes, one line at least; images whole
                n = lines if b["kind"] == "image" else max(fitting_noted(start, lines, line_h, room, heights, counted, first, False, 1), 1)
            out.append({"seq": b["seq"], "kind": b["kind"], "note": None, "page": page, "first_line": start, "n_lines": n, "y": y + gap, "h": n * line_h})
            met = [(b["seq"], note, h) for line in own[start : start + n] for note, h in line]
            area += sum(h for _, _, h in met) + (note_gap if met and not area else 0.0)
            waiting += met
            y, used, start = y + gap + n * line_h, True, start + n
            if start < lines:
                turn()
        pending, forced = float(b["after"] or 0), bool(b["break_after"])
    turn()
    return out


def whole_pages(blocks: DataFrame, headers: DataFrame, watermarks: DataFrame, endnotes: DataFrame, usable: float = 697.9, least: int = 2, notes_counted: int = 1, note_gap: float = 6.0, key: str = "doc_id") -> DataFrame:
    """(key, page, layer, seq, kind, note, first_line, n_lines, y, h): everything on every page of the documents.

    Layers: `body` pieces and the `footnote` lines of each page as in ``assembled``, but with notes where their references are: ``blocks`` have notes (array of line, id, h), each line
    brings its notes to its page, and the area they take at the page's foot (``note_gap`` above the first) is room that the body loses, so that a reference may be the one that no longer fits.
    `endnotes`: (key, seq, lines, line_h) go on behind the body, from a new page on. `header`: (key, variant, text) by page: `first` on the first, `even` on even ones, else `default`, where a document has
    the variant. `watermark`: (key, text) on every page. ``notes_counted``: how often an area counts against the room; the usual layout counts it twice.
    """
    types = dict(blocks.dtypes)
    schema = StructType.fromDDL(f"{key} {types[key]}, seq {types['seq']}, kind string, note string, page int, first_line int, n_lines int, y double, h double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        """Columns, not structs, of blocks that lie in order; a document may go on in the next batch."""
        out: list[dict] = []
        for k, own in groupby((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (key, *NOTED)), strict=True)), itemgetter(0)):
            out += [{key: k} | r for r in assemble_noted([dict(zip(NOTED, row[1:], strict=True)) for row in own], usable, least, notes_counted, note_gap)]
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in arrow], schema=arrow)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in arrow], schema=arrow)

    at = scratch.folder(blocks.sparkSession)
    ordered = scratch.dealt(blocks.select(key, *NOTED), key).sortWithinPartitions(key, *NOTED)
    placed = scratch.written(ordered.mapInArrow(run, schema), "placed", at)  # read three times, assembled once
    body = placed.withColumn("layer", F.when(F.col("kind") == "footnote", "footnote").otherwise("body"))
    last = placed.groupBy(key).agg(F.max("page").alias("_last"))
    # endnotes fill pages of their own: lines in one running sum, a page holds as many as fit whole
    lines = F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1))
    per_page = lambda high: F.greatest(F.floor(F.lit(usable + EPSILON) / high), F.lit(1))
    ends = endnotes.select(key, "seq", lines.alias("lines"), "line_h")
    high = F.max("line_h").over(Window.partitionBy(key))
    before = F.sum("lines").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines")
    ends = scratch.dealt(ends, key).select(key, "seq", "lines", "line_h", high.alias("_high"), per_page(high).alias("_per"), before.alias("_n"))
    ends = ends.select("*", F.explode(F.expr("sequence(_n div _per, (_n + lines - 1) div _per)")).alias("_page"))
    ends = ends.withColumn("first_line", F.expr("greatest(_page * _per - _n, 0)")).withColumn("n_lines", F.expr("least(lines, (_page + 1) * _per - _n) - first_line"))
    notes = ends.select(key, "seq", "_page", F.col("first_line").cast("int").alias("first_line"), F.col("n_lines").cast("int").alias("n_lines"), F.expr("(_n + first_line) % _per * _high").alias("y"), (F.col("n_lines") * F.col("line_h")).alias("h"))
    notes = notes.join(last.hint("merge"), key, "left").select(key, F.col("seq").cast(types["seq"]).alias("seq"), F.lit("endnote").alias("kind"), F.lit(None).cast("string").alias("note"), (F.coalesce("_last", F.lit(0)) + F.col("_page") + 1).cast("int").alias("page"), "first_line", "n_lines", "y", "h", F.lit("endnotes").alias("layer"))
    content = body.unionByName(notes)
    behind = endnotes.groupBy(key).agg(F.ceil(F.sum(lines) / per_page(F.max("line_h"))).alias("_ends"))
    whole = scratch.written(last.hint("merge").join(behind, key, "full").select(key, (F.coalesce("_last", F.lit(0)) + F.coalesce("_ends", F.lit(0))).cast("int").alias("_last")), "pages", at)
    pages = whole.select(key, F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("page"))
    variants = headers.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("variant", "text"))).alias("_v"))
    of = lambda name: F.try_element_at(F.col("_v"), F.lit(name))
    text = F.coalesce(F.when(F.col("page") == 1, of("first")), F.when(F.col("page") % 2 == 0, of("even")), of("default"))
    extra = lambda df, layer: df.select(key, F.lit(-1).cast(types["seq"]).alias("seq"), F.lit(layer).alias("kind"), F.col("text").alias("note"), "page", F.lit(0).alias("first_line"), F.lit(1).alias("n_lines"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.lit(layer).alias("layer"))
    tops = extra(pages.join(variants.hint("merge"), key).withColumn("text", text).filter("text IS NOT NULL"), "header")
    marks = extra(pages.join(watermarks.select(key, "text").hint("merge"), key), "watermark")
    return content.unionByName(tops).unionByName(marks).select(key, "page", "layer", "seq", "kind", "note", "first_line", "n_lines", "y", "h")
