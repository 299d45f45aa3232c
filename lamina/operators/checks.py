"""Checks of whole documents: issues by rule, summaries of them, comparison of a document with its round trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import scratch


def _issues(rows: DataFrame, broken: Column, level: str, rule: str, kind: str, element: str) -> DataFrame:
    return rows.filter(broken).select("doc_id", F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.col(element).cast("string").alias("element"))


def without(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """``rows`` whose keys ``known`` hasn't. Both go to a fixed number of partitions: rows that compress well would be put together until a sort fills a task's memory."""
    return scratch.dealt(rows, *keys).join(scratch.dealt(known.select(*keys), *keys), list(keys), "left_anti")


def dangling(rows: DataFrame, reference: str, targets: DataFrame, key: str, rule: str, kind: str, element: str) -> DataFrame:
    """Warnings for references of a document that none of its own targets meets."""
    known = targets.select("doc_id", F.col(key).alias(reference))
    left = without(rows.filter(F.col(reference).isNotNull() & (F.col(reference) != "")).select("doc_id", reference, F.col(element).cast("string").alias(element)), known, "doc_id", reference)
    return _issues(left, F.lit(True), "warning", rule, kind, element)


def document_issues(documents: DataFrame, tables: DataFrame, styles: DataFrame, instances: DataFrame, abstract: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, level, rule, kind, element) of five tables' rules.

    documents (doc_id, text), tables (doc_id, table_id, n_rows, text), styles (doc_id, style_id, name, type, based_on), numbering instances
    (doc_id, num_id, abstract_id), abstract numberings (doc_id, abstract_id), sections (doc_id, section, margins boolean).
    A document without rows of styles or sections has an issue of its own.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    none = lambda other, rule, kind: _issues(without(documents.select("doc_id"), other, "doc_id"), F.lit(True), "warning", rule, kind, "doc_id")
    parts = [
        _issues(documents, blank("text"), "warning", "no_text", "document", "doc_id"),
        _issues(tables, F.col("n_rows") == 0, "warning", "no_rows", "table", "table_id"),
        _issues(tables, blank("text"), "warning", "empty_table", "table", "table_id"),
        none(styles, "no_styles", "styles"), none(sections, "no_sections", "sections"),
        _issues(styles, blank("name"), "warning", "no_name", "style", "style_id"),
        _issues(styles, blank("type"), "warning", "no_type", "style", "style_id"),
        dangling(styles, "based_on", styles, "style_id", "missing_base", "style", "style_id"),
        dangling(instances, "abstract_id", abstract, "abstract_id", "missing_abstract", "numbering", "num_id"),
        _issues(sections, ~F.col("margins"), "warning", "no_margins", "section", "section"),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(blocks: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, valid, errors, warnings, pages, blocks) of each document with blocks."""
    found = issues.groupBy("doc_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    own = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("blocks")).join(found, "doc_id", "left")
    own = own.fillna(0, ["errors", "warnings"])
    return own.select("doc_id", (F.col("errors") == 0).alias("valid"), "errors", "warnings", "pages", "blocks")


def compared(original: DataFrame, again: DataFrame, first: int = 20) -> DataFrame:
    """(doc_id, lost, text_lost, lost_percent, equal_places): paragraphs and characters lost, and equal texts among the first places.

    Both sides are joined by place, so a document's rows need not meet in one task before they are counted.
    """
    pair = original.select("doc_id", "seq", F.col("text").alias("old")).join(again.select("doc_id", "seq", F.col("text").alias("new")), ["doc_id", "seq"], "full_outer")
    length = lambda c: F.sum(F.coalesce(F.char_length(c), F.lit(0)))
    found = pair.groupBy("doc_id").agg((F.count("old") - F.count("new")).alias("lost"), length("old").alias("_old"), length("new").alias("_new"), F.count_if((F.col("seq") < first) & (F.col("old") == F.col("new"))).alias("equal_places"))
    lost = F.col("_old") - F.col("_new")
    return found.select("doc_id", "lost", lost.alias("text_lost"), F.when(F.col("_old") > 0, F.round(lost / F.col("_old") * 100, 2)).otherwise(0.0).alias("lost_percent"), "equal_places")
