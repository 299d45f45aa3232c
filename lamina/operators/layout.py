"""Pages and placed blocks: header variants, spacing, places of breaks, notes of pages and layout checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import formats


def page_label(page: str, form: str) -> str:
    """SQL expression: a page's number as roman, letters or digits."""
    return f"CASE {form} WHEN 'roman' THEN {formats.roman(page)} WHEN 'letters' THEN {formats.letters(page)} ELSE CAST({page} AS string) END"


def variant(page: str, variants: str) -> Column:
    """The header or footer of a page from a map of variants: its own kind (first, even, odd), else the default one, else null."""
    kind = F.when(F.col(page) == 1, "first").when(F.col(page) % 2 == 0, "even").otherwise("odd")
    filled = F.map_filter(variants, lambda _, v: v != "")
    return F.coalesce(F.try_element_at(filled, kind), F.try_element_at(filled, F.lit("default")))


def page_of(positions: DataFrame, breaks: DataFrame) -> DataFrame:
    """Adds page to (doc_id, position): that of the first break (doc_id, position, page_number) at or behind it, else 1.

    Positions and breaks are sorted together, so no pairs arise.
    """
    both = positions.withColumn("page_number", F.lit(None).cast("int")).withColumn("_break", F.lit(0)).unionByName(breaks.select("doc_id", "position", F.col("page_number").cast("int")).withColumn("_break", F.lit(1)), allowMissingColumns=True)
    behind = Window.partitionBy("doc_id").orderBy("position", "_break").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("page", F.coalesce(F.first("page_number", ignorenulls=True).over(behind), F.lit(1)))
    return found.filter(F.col("_break") == 0).drop("_break", "page_number")


def spaced(blocks: DataFrame) -> DataFrame:
    """gap before each block of (doc_id, seq, before, after): the larger of its own and the one behind its predecessor, 1 if neither asks for any."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    pending = F.coalesce(F.lag("after").over(order), F.lit(0))
    bare = F.lag("seq").over(order).isNotNull() & (pending <= 0) & (F.col("before") <= 0)
    return blocks.withColumn("gap", F.when(bare, F.lit(1)).otherwise(F.greatest(pending, F.col("before"), F.lit(0))))


def grid_widths(grid: str, columns: str) -> str:
    """SQL expression: points of the columns of a grid of texts in twips; missing ones get the mean, surplus ones go."""
    known = f"transform(filter(transform({grid}, g -> try_cast(g AS double)), g -> g IS NOT NULL), g -> greatest(g / 20.0D, 0D))"
    mean = f"aggregate({known}, 0D, (a, g) -> a + g, a -> a / size({known}))"
    return f"if(size({known}) = 0, {known}, slice(concat({known}, array_repeat({mean}, greatest({columns} - size({known}), 0))), 1, {columns}))"


def notes_of_pages(references: DataFrame) -> DataFrame:
    """(doc_id, page, notes): the distinct notes of each page by first reference."""
    first = references.groupBy("doc_id", "page", "note_id").agg(F.min("seq").alias("seq"))
    return first.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "note_id")))["note_id"].alias("notes"))


def signatures(rows: DataFrame, numbered: str, indent: str, *style: str) -> DataFrame:
    """Rows of one document with equal signatures as groups: n and first_seq. Numbered rows leave the indent out of theirs."""
    own = rows.withColumn(indent, F.when(~F.col(numbered), F.col(indent)))
    return own.groupBy("doc_id", numbered, indent, *style).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def issues(blocks: DataFrame, width: float, height: float, bottom: float) -> DataFrame:
    """(doc_id, page, idx, level, rule): one row for each rule that a block breaks.

    Blocks are (doc_id, page, idx, x, y, w, h, styled, before, after), y upwards from the foot of the page. A block must lie on the page,
    above the bottom margin, have a size and a style and no negative spacing; it must not overlap the one before it on the page
    and should keep half of the spacing that both ask for.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("idx")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)
    wanted = F.lag("after").over(order) + F.col("before")
    rules = {
        "left_edge": ("error", F.col("x") < 0), "right_edge": ("error", F.col("x") + F.col("w") > width),
        "bottom_edge": ("error", F.col("y") < 0), "top_edge": ("error", F.col("y") + F.col("h") > height),
        "width": ("error", F.col("w") <= 0), "height": ("error", F.col("h") <= 0),
        "style": ("warning", ~F.col("styled")), "before": ("warning", F.col("before") < 0), "after": ("warning", F.col("after") < 0),
        "margin": ("error", F.col("y") < bottom), "overlap": ("error", F.col("_gap") < 0),
        "spacing": ("warning", (F.col("_gap") >= 0) & (F.col("_gap") < F.col("_wanted") * 0.5)),
    }
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for rule, (level, broken) in rules.items())))
    return blocks.withColumns({"_gap": gap, "_wanted": wanted}).select("doc_id", "page", "idx", F.inline(found))


def page_issues(pages: DataFrame) -> DataFrame:
    """(doc_id, page, rule) for pages (doc_id, place from 1, page, blocks) whose number isn't their place, and for later ones without content."""
    rules = {"page_number": F.col("page") != F.col("place"), "empty_page": (F.col("blocks") == 0) & (F.col("page") > 1)}
    found = F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())))
    return pages.select("doc_id", "page", F.explode(found).alias("rule"))


def paragraph_break(total: str, start: str, line: str, available: str, top: str = "0D", bottom: str = "0D", keep: str = "false", least: int = 2) -> str:
    """SQL expression: the line before which a paragraph breaks (``start`` if none fits, ``total`` if all do), with lines of one height.

    ``top`` counts before the first line and ``bottom`` behind the last. At least ``least`` lines go over and at least as many stay.
    A paragraph that is kept together and doesn't fit gives null.
    """
    room = f"({available} + 1e-6 - if({start} = 0, {top}, 0D))"
    rest = f"({total} - {start})"
    natural = f"least(greatest(CAST(floor({room} / {line}) AS int), 0), {rest} - 1)"
    here = f"({natural} - greatest({least} - ({rest} - {natural}), 0))"
    return f"CASE WHEN {rest} <= 0 OR {rest} * {line} + {bottom} <= {room} THEN {total} WHEN {keep} AND {start} = 0 THEN NULL WHEN {natural} <= 0 OR {here} < {least} THEN {start} ELSE {start} + {here} END"


def header_places(items: DataFrame, page_height: float, distance: float) -> DataFrame:
    """y of each header item of (doc_id, variant, seq, before, h, after), stacked downwards from the header's distance."""
    h = F.when(F.col("h") > 0, F.col("h")).otherwise(20.0)
    above = Window.partitionBy("doc_id", "variant").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("before") + h + F.col("after")).over(above), F.lit(0.0))
    return items.withColumn("y", page_height - distance - used - F.col("before") - h)


def body_offsets(items: DataFrame, distance: float, margin: float) -> DataFrame:
    """(doc_id, variant, offset): where the body begins: the margin, or behind what the variant's items use if that is more."""
    h = F.when(F.col("h") > 0, F.col("h")).otherwise(20.0)
    used = distance + F.sum(F.col("before") + h + F.col("after"))
    return items.groupBy("doc_id", "variant").agg(F.greatest(F.lit(margin), used).alias("offset"))
