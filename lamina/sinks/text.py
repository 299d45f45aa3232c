"""Text forms of whole documents: plain text, a CSV stream of paragraphs and tables, and checks of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text as T


def plain(rows: DataFrame, title: Column) -> DataFrame:
    """(doc_id, text): the title, then paragraphs, tables and other kinds, blank ones dropped."""
    part = F.when(F.col("kind") == "paragraph", 0).when(F.col("kind") == "table", 1).otherwise(2)
    own = F.sort_array(F.collect_list(F.struct(part.alias("part"), "seq", "text")))
    found = rows.filter(F.trim("text") != "").groupBy("doc_id").agg(F.array_join(own["text"], "\n").alias("body")).withColumn("_title", title)
    return found.select("doc_id", F.concat(F.expr(T.heading("_title", "1")), F.lit("\n\n"), "body").alias("text"))


def finished(text: str) -> str:
    """SQL expression: two line ends at most, one more before headings and table rows, trimmed, a line end behind."""
    for pattern, by in ((r"\\n{3,}", r"\\n\\n"), (r"\\n(#{1,6}\\s)", r"\\n\\n$1"), (r"\\n(\\|)", r"\\n\\n$1")):
        text = f"regexp_replace({text}, '{pattern}', '{by}')".replace("\\\\n\\\\n", "\\n\\n")
    return f"concat(trim(BOTH ' \\t\\n\\r' FROM {text}), '\\n')"


def csv_stream(rows: DataFrame, separator: str = ",") -> DataFrame:
    """(doc_id, csv): rows with cells as they are, others as `Paragraph` and their text (blank ones dropped), in order, quoted where needed."""
    fields = F.coalesce("cells", F.array(F.lit("Paragraph"), "text"))
    quoted = F.transform(fields, lambda c: F.when(c.rlike(f'[{separator}"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    lines = rows.filter(F.col("cells").isNotNull() | (F.trim("text") != "")).select("doc_id", F.struct("seq", F.concat(F.array_join(quoted, separator), F.lit("\r\n")).alias("line")).alias("x"))
    return lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "").alias("csv"))


def markdown_line_valid(line: str) -> str:
    """SQL expression: headings have a blank behind one to six signs; rows of tables start with a bar, unless they are list items."""
    return f"(NOT startswith({line}, '#') OR {line} RLIKE '^#{{1,6}}[ \\\\t]') AND ({line} RLIKE '^[ \\\\t]*([*+-]|[0-9]+[.])[ \\\\t]' OR NOT contains({line}, '|') OR startswith(ltrim({line}), '|'))"


def flat_json(rows: DataFrame) -> DataFrame:
    """(doc_id, json): the elements of a document in order as one list; empty texts leave no key."""
    element = F.struct("seq", F.struct(F.col("kind").alias("type"), F.concat_ws("_", "kind", "seq").alias("id"), F.nullif("text", F.lit("")).alias("text")).alias("e"))
    return rows.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("flat").alias("document_type"), F.sort_array(F.collect_list(element))["e"].alias("elements"))).alias("json"))


def html(rows: DataFrame) -> DataFrame:
    """(doc_id, html): paragraphs in order, escaped, line ends as breaks."""
    line = F.concat(F.lit("<p>"), F.replace(F.expr(T.escape_html("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    return rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))["line"], "\n").alias("html"))


def nested_json(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the elements of a document in order below its body; tables hold their rows, and these the cells (doc_id, seq, row_idx, col_idx, text)."""
    own = rows.withColumn("_table", F.lit(None).cast("struct<rows:array<struct<cells:array<struct<text:string>>>>>"))
    if cells is not None:
        row = cells.repartition("doc_id", "seq").groupBy("doc_id", "seq", "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "text"))), lambda c: F.struct(c["text"].alias("text"))).alias("cells"))
        table = row.groupBy("doc_id", "seq").agg(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))), lambda r: F.struct(r["cells"].alias("cells"))).alias("rows")).alias("_table"))
        own = rows.join(table, ["doc_id", "seq"], "left")
    element = F.struct("seq", F.struct(F.col("kind").alias("type"), F.concat_ws("_", "kind", "seq").alias("id"), F.nullif("text", F.lit("")).alias("text"), F.col("_table").alias("table")).alias("e"))
    body = F.struct(F.lit("body").alias("type"), F.sort_array(F.collect_list(element))["e"].alias("elements"))
    return own.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("hierarchical").alias("document_type"), F.struct(body.alias("body")).alias("document"))).alias("json"))


def html_pages(placed: DataFrame, width: int = 595, height: int = 842) -> DataFrame:
    """(doc_id, html): a division a page, in it one a block of (doc_id, page, seq, x, y, w, text) at its place in points."""
    at = F.concat(*(p for name, c in (("left", "x"), ("top", "y"), ("width", "w")) for p in (F.lit(f"{name}:"), F.col(c).cast("string"), F.lit("pt;"))))
    block = F.concat(F.lit('<div class="block" style="'), at, F.lit('">'), F.replace(F.expr(T.escape_html("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</div>"))
    pages = placed.repartition("doc_id").groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", block.alias("b"))))["b"], "").alias("own"))
    page = F.concat(F.lit('<div class="page" data-page="'), F.col("page").cast("string"), F.lit(f'" style="position:relative;width:{width}pt;height:{height}pt">'), "own", F.lit("</div>"))
    return pages.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", page.alias("p"))))["p"], "\n").alias("html"))


def editable_html(rows: DataFrame) -> DataFrame:
    """(doc_id, html): paragraphs that can be edited in a browser, each with its place, so that an update finds it again."""
    line = F.concat(F.lit('<p contenteditable="true" data-seq="'), F.col("seq").cast("string"), F.lit('">'), F.replace(F.expr(T.escape_html("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    return rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))["line"], "\n").alias("html"))


def tidied_markdown(text: str) -> str:
    """SQL expression: at most one blank line, and one before each heading, list item and table row that follows a line."""
    out = f"regexp_replace({text}, '\\n{{3,}}', '\\n\\n')"
    for mark in (r"#{1,6}\\s", r"[*+-]\\s", r"\\d+\\.\\s", r"\\|"):
        out = f"regexp_replace({out}, '\\n({mark})', '\\n\\n$1')"
    return f"btrim({out}, ' \\t\\n\\u000B\\u000C\\r')"


def markdown_documents(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown) of elements (key, seq, kind, text, level, form): headings, list items, table rows (text is the line) and paragraphs in order, tidied."""
    mark = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "))).when(F.col("kind") == "list_item", F.when(F.col("form") == "bullet", "- ").otherwise("1. ")).otherwise("")
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat(mark, "text").alias("line"))))["line"]
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("markdown")).withColumn("markdown", F.expr(tidied_markdown("markdown")))


def text_tables(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, text): rows (key, row, cells) as lines of cells padded to their column's width, a line of dashes behind the first."""
    cells = rows.select(key, "row", F.posexplode("cells").alias("col", "cell"))
    width = F.max(F.char_length("cell")).over(Window.partitionBy(key, "col"))
    lines = cells.withColumn("cell", F.rpad("cell", width, F.lit(" "))).groupBy(key, "row").agg(F.array_join(F.sort_array(F.collect_list(F.struct("col", "cell")))["cell"], " | ").alias("line"))
    own = F.sort_array(F.collect_list(F.struct("row", "line")))["line"]
    whole = lines.groupBy(key).agg(own.alias("l"))
    return whole.select(key, F.array_join(F.concat(F.slice("l", 1, 1), F.array(F.repeat(F.lit("-"), F.char_length(F.col("l")[0]))), F.slice("l", F.lit(2), F.size("l"))), "\n").alias("text"))


def csv_document(rows: DataFrame, metadata: dict[str, str] | None = None, separator: str = ",") -> DataFrame:
    """(doc_id, csv): metadata rows, then paragraphs and tables in order; each table has a caption `Table N`, its header row first.

    ``rows``: (doc_id, seq, text, tables array<struct<is_header, cells>> or null); blank paragraphs are dropped.
    """
    quoted = lambda cells: F.array_join(F.transform(cells, lambda c: F.when(c.rlike(f'[{separator}"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)), separator)
    kept = rows.filter(F.col("tables").isNotNull() | (F.trim("text") != ""))
    number = F.count("tables").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    body = F.concat(F.filter("tables", lambda t: t["is_header"]), F.filter("tables", lambda t: ~t["is_header"]))
    table = F.concat(F.array(F.concat(F.lit("Table "), number)), F.transform(body, lambda t: quoted(t["cells"])))
    lines = kept.select("doc_id", "seq", F.when(F.col("tables").isNotNull(), table).otherwise(F.array(quoted(F.array(F.lit("Paragraph"), "text")))).alias("lines"))
    head = [F.lit(f"{k}{separator}{v}") for k, v in (metadata or {}).items()]
    whole = F.flatten(F.sort_array(F.collect_list(F.struct("seq", "lines")))["lines"])
    return lines.groupBy("doc_id").agg(F.array_join(F.concat(F.array(*head), whole) if head else whole, "\r\n").alias("csv"))


def flat_elements(rows: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, json): the elements in order with type, id, text and whatever of ``extra`` (style, formatting, position, table_data, image_data) a row has; absent values leave no key."""
    element = F.struct("seq", F.struct(F.col("kind").alias("type"), F.concat_ws("_", "kind", "seq").alias("id"), F.nullif("text", F.lit("")).alias("text"), *extra).alias("e"))
    return rows.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("flat").alias("document_type"), F.sort_array(F.collect_list(element))["e"].alias("elements"))).alias("json"))
