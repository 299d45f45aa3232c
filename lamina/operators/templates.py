"""Template blocks and numbering: conditional sections, lists, images, QR texts, level definitions and indents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text as T


def conditional(rows: DataFrame, name: str, show: bool) -> DataFrame:
    """Rows of (doc_id, seq, text) with the sections between START_name and END_name shown without their markers, or removed with them.

    A section runs from the first START behind the last section to the next END; one without an end stays when hidden.
    """
    spelled = {side: F.exists(F.expr(T.spellings(f"'{side}_{name}'")), lambda p: F.contains(F.col("text"), p)) for side in ("START", "END")}
    if show:
        text = F.col("text")
        for side in spelled:
            text = F.regexp_replace(text, rf"\{{\{{? ?{side}_{name} ?\}}\}}?", "")
        return rows.withColumn("text", text)
    order = Window.partitionBy("doc_id").orderBy("seq")
    marked = rows.withColumn("_mark", F.when(spelled["START"], 1).when(spelled["END"], 0))
    before, behind = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    # a START while a section is open, and an END while none is, change nothing
    state = F.last("_mark", ignorenulls=True).over(before)
    earlier = F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    closes = F.max(F.when(F.col("_mark") == 0, F.col("seq"))).over(behind).isNotNull()
    hidden = ((state == 1) & closes) | ((F.col("_mark") == 0) & (earlier == 1))
    return marked.withColumn("_hidden", F.coalesce(hidden, F.lit(False))).filter(~F.col("_hidden")).drop("_mark", "_hidden")


def list_items(rows: DataFrame, items: str, style: str = "bullet", level: int = 0) -> DataFrame:
    """One numbered paragraph an item: place, text, format, marker template, indent and hanging in twips."""
    form, template = ("bullet", "•") if style == "bullet" else ("decimal", "%1.")
    out = rows.select("*", F.posexplode(items).alias("item", "item_text"))
    return out.withColumns({"format": F.lit(form), "template": F.lit(template), "level": F.lit(level), "indent_left": F.lit(720 * (level + 1)), "indent_hanging": F.lit(360)})


def image_size(width: str, height: str, own_width: str, own_height: str) -> str:
    """SQL expression (struct w, h): a missing side follows the other one; with neither, the image's own size, 400 wide at most."""
    whole = lambda x: f"CAST({x} AS int)"
    own = f"if({own_width} > 400, named_struct('w', 400, 'h', {whole(f'{own_height} * (400.0D / {own_width})')}), named_struct('w', {whole(own_width)}, 'h', {whole(own_height)}))"
    by_height = f"named_struct('w', {whole(f'{own_width} * (CAST({height} AS double) / {own_height})')}, 'h', {whole(height)})"
    by_width = f"named_struct('w', {whole(width)}, 'h', {whole(f'{own_height} * (CAST({width} AS double) / {own_width})')})"
    return f"CASE WHEN {width} IS NULL AND {height} IS NULL THEN {own} WHEN {width} IS NULL THEN {by_height} WHEN {height} IS NULL THEN {by_width} ELSE named_struct('w', {whole(width)}, 'h', {whole(height)}) END"


def qr_text(text: str) -> str:
    """SQL expression: what stands for a QR code where none can be drawn."""
    return f"concat('[QR: ', {text}, ']')"


def levels(instances: DataFrame, abstract: DataFrame, overrides: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, num_id, level, format, template, start) of each numbering instance of a document: its abstract level with the override's non-empty values on top.

    Instances are (key, num_id, abstract_id), abstract levels (key, abstract_id, level, ...), overrides (key, num_id, level, ...).
    """
    over = overrides.select(key, "num_id", "level", *(F.col(c).alias(f"_{c}") for c in ("format", "template", "start")))
    found = instances.join(abstract, [key, "abstract_id"]).join(over, [key, "num_id", "level"], "left")
    text = lambda c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c).alias(c)
    return found.select(key, "num_id", "level", text("format"), text("template"), F.coalesce(F.nullif("_start", F.lit(0)), "start").alias("start"))


def table_rows(rows: DataFrame, name: str, data: DataFrame, style: str = "TableGrid", key: str = "doc_id") -> DataFrame:
    """Rows with tables in place of a table placeholder: (key, seq, part, kind, text, cells, bold, style).

    ``data``: (key, row, cells), row 0 the header, whose cells are bold. A paragraph that holds nothing else gives way to its table (part 1 and on); any other
    keeps its text without the placeholder (part 0) and the table follows. Without a header and a row beneath it nothing changes.
    """
    spelled = [p for p in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}", f"{{ {name} }}", f"{{{name}}}")]
    whole = data.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("_rows")).filter(F.size("_rows") > 1)
    hit = F.lit(False)
    text = F.col("text")
    for p in spelled:
        hit, text = hit | F.contains(F.col("text"), F.lit(p)), F.replace(text, F.lit(p), F.lit(""))
    found = rows.withColumn("_hit", hit).join(whole, key, "left").withColumn("_hit", F.col("_hit") & F.col("_rows").isNotNull()).withColumn("_left", text)
    none = F.lit(None)
    plain = found.filter(~F.col("_hit") | (F.trim("_left") != "")).select(key, "seq", F.lit(0).alias("part"), F.lit("paragraph").alias("kind"), F.when(F.col("_hit"), F.col("_left")).otherwise(F.col("text")).alias("text"), none.cast("array<string>").alias("cells"), F.lit(False).alias("bold"), none.cast("string").alias("style"))
    table = found.filter("_hit").select(key, "seq", F.posexplode("_rows").alias("part", "r"))
    return plain.unionByName(table.select(key, "seq", (F.col("part") + 1).alias("part"), F.lit("table_row").alias("kind"), F.lit("").alias("text"), F.col("r.cells").alias("cells"), (F.col("part") == 0).alias("bold"), F.lit(style).alias("style")))


def watermarks(rows: DataFrame, name: str, text: str, angle: int = 45, opacity: float = 0.5, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows with a watermark placeholder blanked, and (key, text, angle, opacity) of the documents that had one."""
    hit, blank = F.lit(False), F.col("text")
    for p in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}", f"{{ {name} }}", f"{{{name}}}"):
        hit, blank = hit | F.contains(F.col("text"), F.lit(p)), F.replace(blank, F.lit(p), F.lit(""))
    marked = rows.filter(hit).select(key).distinct().select(key, F.lit(text).alias("text"), F.lit(angle).alias("angle"), F.lit(opacity).alias("opacity"))
    return rows.withColumn("text", blank), marked


def rewound_counters(events: DataFrame, key: str, order: str, step: Column, start: int = 1) -> DataFrame:
    """counter after each event of +1 (an item) or -1 (one taken back), never below start - 1.

    The floor adds what the running sum fell below zero so far, so windows suffice.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_sum", F.sum(step).over(before))
    low = F.least(F.min("_sum").over(before), F.lit(0))
    return events.withColumn("counter", F.col("_sum") - low + start - 1).drop("_sum")


def combined_indent(style: str, level: str, paragraph: str, side: str) -> str:
    """SQL expression: one side of an indent: the level's replaces the style's, a paragraph's own side other than zero replaces both."""
    return f"coalesce(nullif({paragraph}.{side}, 0), if({level} IS NULL, {style}.{side}, {level}.{side}))"


def first_line(hanging: str, first: str) -> str:
    """SQL expression: the first line's indent, null beside a hanging one."""
    return f"if(coalesce({hanging}, 0) <> 0, NULL, {first})"


def field_option(instruction: str, switch: str) -> str:
    """SQL expression: what follows a switch such as `*` or `#` up to the next of its kind, trimmed; null without it."""
    return f"if(contains({instruction}, '\\\\{switch}'), trim(split_part({instruction}, '\\\\{switch}', 2)), NULL)"


def field_value(instruction: str, page: str, pages: str, moment: str) -> str:
    """SQL expression: the value of a field on a page; dates and times in their usual pictures."""
    head = f"upper(trim({instruction}))"
    bookmark = f"split_part(trim({instruction}), ' ', 2)"
    return f"""CASE WHEN {head} LIKE 'PAGE%' THEN CAST({page} AS string) WHEN {head} LIKE 'DATE%' THEN {T.date(moment)} WHEN {head} LIKE 'REF%' THEN concat('[REF: ', {bookmark}, ']')
        WHEN {head} LIKE 'TOC%' THEN '[TOC]' WHEN {head} LIKE 'NUMPAGES%' THEN CAST({pages} AS string) WHEN {head} LIKE 'TIME%' THEN {T.date(moment, 'time')} ELSE {instruction} END"""


def replaced_in_runs(rows: DataFrame, runs: str, placeholder: str, value: Column) -> DataFrame:
    """Array column ``runs`` of texts with the first occurrence of a placeholder replaced, even where it spans runs.

    The run in which it begins takes the value and what follows the placeholder in the run where it ends; those between become empty.
    """
    begin = F.instr("_full", placeholder) - 1
    end = F.col("_begin") + len(placeholder)
    rows = rows.withColumn("_full", F.array_join(runs, "")).withColumn("_begin", begin).withColumn("_end", end)
    ends = F.aggregate(runs, F.array().cast("array<int>"), lambda a, r: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.char_length(r)))
    last = F.array_min(F.filter("_ends", lambda e: e >= F.col("_end")))

    def run(text: Column, i: Column) -> Column:
        stop = F.get("_ends", i)
        start = stop - F.char_length(text)
        met = (start < F.col("_end")) & (stop > F.col("_begin"))
        first = F.concat(F.substring(text, F.lit(1), F.col("_begin") - start), value, F.substring("_full", F.col("_end") + 1, F.col("_last") - F.col("_end")))
        return F.when(~met, text).when(start <= F.col("_begin"), first).otherwise("")

    rows = rows.withColumn("_ends", ends).withColumn("_last", last)
    rows = rows.withColumn(runs, F.when(F.col("_begin") < 0, F.col(runs)).otherwise(F.transform(runs, run)))
    return rows.drop("_full", "_begin", "_end", "_ends", "_last")


def typed(key: str, value: str) -> str:
    """SQL expression: a value as its placeholder's type (`CURRENCY:Sum`) shows it; null is the empty text."""
    text = f"cast({value} AS string)"
    shown = {"CURRENCY": lambda: T.currency(value), "DATE": lambda: T.date(value), "TIME": lambda: T.date(value, "time"), "NUMBER": lambda: T.number(value), "PERCENT": lambda: T.percent(value), "PHONE": lambda: T.phone(text), "EMAIL": lambda: T.email(text), "BOOLEAN": lambda: T.boolean(text)}
    return f"coalesce({shown.get(key.partition(':')[0].upper() if ':' in key else '', lambda: text)()}, '')"


def replaced_counted(rows: DataFrame, key: str, value: str, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (paragraphs and cells alike) with every spelling of a placeholder replaced, and (doc_id, n): how many pairs of a row and a spelling were met."""
    spelled = [a + n + b for n in filter(None, (key, key.partition(":")[2])) for a, b in (("{{ ", " }}"), ("{{ ", "}}"), ("{{", " }}"), ("{{", "}}"), ("{ ", " }"), ("{", "}"))]
    # a spelling counts in what the ones before it left
    text, hits = F.col(column), F.lit(0)
    for p in spelled:
        hits = hits + F.contains(text, F.lit(p)).cast("int")
        text = F.replace(text, F.lit(p), F.lit(value))
    return rows.withColumn(column, text), rows.groupBy("doc_id").agg(F.sum(hits).alias("n"))


def image_rows(rows: DataFrame, name: str, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with images in place of an image placeholder: (key, seq, part, kind, text, path, width, height).

    ``images``: (key, path, width, height wanted or null, own_width, own_height). The paragraph keeps its text without the placeholder, a document's images follow it by their paths.
    """
    hit, text = F.lit(False), F.col("text")
    for p in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}", f"{{ {name} }}", f"{{{name}}}"):
        hit, text = hit | F.contains(F.col("text"), F.lit(p)), F.replace(text, F.lit(p), F.lit(""))
    size = F.expr(image_size("width", "height", "own_width", "own_height"))
    all_images = images.filter("path IS NOT NULL").select(key, F.struct("path", size.alias("size")).alias("_i")).groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_images"))
    found = rows.withColumn("_hit", hit).withColumn("_left", text).join(all_images, key, "left").withColumn("_hit", F.col("_hit") & F.col("_images").isNotNull())
    plain = found.select(key, "seq", F.lit(0).alias("part"), F.lit("paragraph").alias("kind"), F.when(F.col("_hit"), F.col("_left")).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    own = found.filter("_hit").select(key, "seq", F.posexplode("_images").alias("part", "_i"))
    own = own.select(key, "seq", (F.col("part") + 1).alias("part"), F.lit("image").alias("kind"), F.lit("").alias("text"), F.col("_i.path").alias("path"), F.col("_i.size.w").alias("width"), F.col("_i.size.h").alias("height"))
    return plain.unionByName(own)
