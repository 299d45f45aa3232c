"""Tables of documents as rows (key, row, cells array, is_header): statistics, structure, advice and text forms.

Cells stay in their array; statistics fold over it and aggregate with a map-side part. Text forms gather one table's rows, no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Advice on a document's layout.
ADVICE_TABLE_HEAVY = ("Consider breaking up large tables into smaller sections", "Add explanatory text between tables")
ADVICE_IMAGE_HEAVY = ("Add captions or descriptions for images", "Consider adding text content to balance the layout")
ADVICE_MERGED = "Consider simplifying table structure by reducing merged cells"
ADVICE_NESTED = "Nested tables can be difficult to read - consider flattening structure"
ADVICE_EMPTY = "Table has many empty cells - consider restructuring"
ADVICE_LONG = "Document is quite long - consider adding section breaks or headings"
ADVICE_NONE = "Document layout looks good - no specific recommendations"


def content(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Filled and empty cells, length of the filled ones' texts, its mean over all cells, and whether the first row is a header."""
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    length = F.aggregate(filled, F.lit(0), lambda a, c: a + F.char_length(c))
    found = rows.groupBy(key).agg(F.sum(F.size(filled)).alias("filled"), F.sum(F.size("cells") - F.size(filled)).alias("empty"), F.sum(length).alias("text_length"), F.min_by("is_header", "row").alias("has_header"))
    total = F.col("filled") + F.col("empty")
    return found.withColumn("mean_length", F.when(total > 0, F.col("text_length") / total).otherwise(0.0))


def structure(rows: DataFrame, merged: Column, tables: Column, images: Column, key: str = "doc_id") -> DataFrame:
    """Whether any row holds merged cells, nested tables or nested images; the score these give; regular if it is zero."""
    found = rows.groupBy(key).agg(F.bool_or(merged).alias("merged"), F.bool_or(tables).alias("nested_tables"), F.bool_or(images).alias("nested_images"))
    score = F.when(F.col("merged"), 2).otherwise(0) + F.when(F.col("nested_tables"), 3).otherwise(0) + F.when(F.col("nested_images"), 1).otherwise(0)
    return found.withColumn("score", score).withColumn("regular", F.col("score") == 0)


def difficulty(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, points, difficulty) from the balance of each document and the scores of its tables; documents without tables stay."""
    each = F.when(F.col("score") > 2, 2).when(F.col("score") > 0, 1).otherwise(0)
    found = documents.select("doc_id", "balance").join(tables.groupBy("doc_id").agg(F.sum(each).alias("_points")), "doc_id", "left")
    base = F.when(F.col("balance") == "table_heavy", 3).when(F.col("balance") == "image_heavy", 2).when(F.col("balance") == "mixed_layout", 4).otherwise(0)
    points = base + F.coalesce("_points", F.lit(0))
    return found.select("doc_id", points.alias("points"), F.when(points >= 8, "high").when(points >= 4, "medium").otherwise("low").alias("difficulty"))


def _texts(*texts: str) -> Column:
    return F.array(*map(F.lit, texts)).cast("array<string>")


def advice(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, advice array): on the balance, on each table in order (may repeat), on the length; one sentence if there is nothing to say."""
    own = F.array_compact(F.array(F.when(F.col("merged"), ADVICE_MERGED), F.when(F.col("nested_tables"), ADVICE_NESTED), F.when(F.col("empty") > F.col("filled"), ADVICE_EMPTY)))
    gathered = tables.groupBy("doc_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("table_id", own.alias("own"))))["own"]).alias("_tables"))
    found = documents.join(gathered, "doc_id", "left")
    balance = F.when(F.col("balance") == "table_heavy", _texts(*ADVICE_TABLE_HEAVY)).when(F.col("balance") == "image_heavy", _texts(*ADVICE_IMAGE_HEAVY)).otherwise(_texts())
    long = F.when(F.col("total") > 100, _texts(ADVICE_LONG)).otherwise(_texts())
    found = found.select("doc_id", F.concat(balance, F.coalesce("_tables", _texts()), long).alias("advice"))
    return found.withColumn("advice", F.when(F.size("advice") == 0, _texts(ADVICE_NONE)).otherwise(F.col("advice")))


def gathered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rows array<array<string>>): the cells of each table in order."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row", "cells")))["cells"].alias("rows"))


def flat_payload(tables: DataFrame) -> DataFrame:
    """columns (cells of the first row) and total_cells of gathered tables."""
    return tables.withColumns({"columns": F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0)), "total_cells": F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(r))})


def cell(row: int, column: int) -> Column:
    """The cell at a place of gathered tables, or null."""
    return F.get(F.get("rows", F.lit(row)), F.lit(column))


def table_text() -> Column:
    """Filled cells of gathered tables joined by tabs, rows by line ends."""
    return F.array_join(F.transform("rows", lambda r: F.array_join(F.filter(r, lambda c: c != ""), "\t")), "\n")


def markdown(style: str = "pipe") -> Column:
    """Gathered tables as `pipe`, `grid` or `simple` text; the first row of the first two has a rule below."""
    left, between, right = {"pipe": ("| ", " | ", " |"), "grid": ("+ ", " + ", " +"), "simple": ("", "  ", "")}[style]
    line = lambda cells: F.concat(F.lit(left), F.array_join(cells, between), F.lit(right))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get("rows", F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform("rows", line)
    if style != "simple":
        lines = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size("rows") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def border_groups(rows: DataFrame, border: str) -> DataFrame:
    """(doc_id, first_seq, last_seq, n): neighbours with one border that is drawn around them together; null borders make no group."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    new = F.when(F.lag(border).over(order) == F.col(border), 0).otherwise(1)
    numbered = rows.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = numbered.filter(F.col(border).isNotNull()).groupBy("doc_id", "_g").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))
    return groups.filter("n > 1").drop("_g")


def autofit_widths(cells: DataFrame, key: str, column: str, width: str, usable: float, padding: float = 10.0, least: float = 20.0) -> DataFrame:
    """(key, column, width): each column as wide as its widest cell with padding, at least ``least``; all shrink alike if they exceed ``usable``."""
    own = cells.groupBy(key, column).agg(F.greatest(F.max(width) + padding, F.lit(least)).alias("width"))
    total = F.sum("width").over(Window.partitionBy(key))
    return own.withColumn("width", F.when(total > usable, F.col("width") * usable / total).otherwise(F.col("width")))
