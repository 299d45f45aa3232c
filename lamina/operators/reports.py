"""Summaries and reports: comments, media, ids, caches, tables, issues, revisions, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.parts import gathered, named

#: Parts that a package must and may have, and the property ranges that validation knows.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
OPTIONAL = ("word/styles.xml", "word/numbering.xml", "word/settings.xml", "word/theme/theme1.xml", "docProps/core.xml", "docProps/app.xml")
COUNTS = ("Pages", "Words", "Characters", "Lines", "Paragraphs", "TotalTime")


def value_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, lo, hi and sd (of the whole population) of a number, by groups."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_pop(value).alias("sd"))


def comments_by(rows: DataFrame, author: str, thread: str, text: str = "text") -> DataFrame:
    """author, total, threads, characters, mean_length."""
    size = F.char_length(text)
    return rows.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("total"), F.countDistinct(thread).alias("threads"), F.sum(size).alias("characters"), F.avg(size).alias("mean_length"))


def media_summary(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """total, bytes and the count of each class of a document's media (type, size)."""
    kinds = ("image", "font", "pdf", "archive", "other")
    return media.groupBy(key).agg(F.count("*").alias("total"), F.sum("size").alias("bytes"), *(F.count_if(F.col("type") == k).alias(k) for k in kinds))


def media_dictionary(media: DataFrame, key: str = "doc_id", path: str = "path", order: str = "seq") -> DataFrame:
    """(key, path, id): each document's media paths numbered from 0 by first use."""
    first = media.groupBy(key, path).agg(F.min(order).alias("_first"))
    return first.select(key, path, (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).alias("id"))


def id_stats(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, n, distinct, clashes): how many ids of a type are registered, and how many more than once."""
    one = ids.groupBy(key, "type", "id").agg(F.count("*").alias("_n"))
    return one.groupBy(key, "type").agg(F.sum("_n").alias("n"), F.count("*").alias("distinct"), F.count_if(F.col("_n") > 1).alias("clashes"))


def hit_rates(asked: DataFrame, hit: Column, *by: str) -> DataFrame:
    """hits and their share of all requests."""
    hits = F.count_if(hit)
    return asked.groupBy(*by).agg(hits.alias("hits"), (hits / F.count("*")).alias("rate"))


def evicted(entries: DataFrame, time: str, entry: str, *by: str) -> DataFrame:
    """The entry that leaves a full cache first: of the least time (expiry or last access), ties to the lesser entry."""
    return entries.groupBy(*by).agg(F.min_by(entry, F.struct(time, entry)).alias("evicted"))


def hierarchy_text(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, children): one line a parent with its children in order."""
    return rows.groupBy(parent).agg(F.array_join(F.array_sort(F.collect_list(child)), ", ").alias("children"))


def column_widths(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The widest text of each column of a table (``key``)."""
    return rows.groupBy(key).agg(*(F.max(F.char_length(F.col(c).cast("string"))).alias(c) for c in columns))


def text_table(rows: DataFrame, key: str, *columns: str, separator: str = " | ") -> DataFrame:
    """``line`` of each row: its cells padded to the width of their column in their table."""
    own = Window.partitionBy(key)
    cells = [F.rpad(F.col(c).cast("string"), F.max(F.char_length(F.col(c).cast("string"))).over(own), F.lit(" ")) for c in columns]
    return rows.withColumn("line", F.concat_ws(separator, *cells))


def markdown_line(*columns: str) -> Column:
    """Cells between bars; a bar in a cell is escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in columns)), F.lit(" |"))


def dimensions(rows: DataFrame, key: str, cells: str) -> DataFrame:
    """n_rows, cells, lo, hi, mean cells a row, and whether all rows have as many."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.sum(cells).alias("cells"), F.min(cells).alias("lo"), F.max(cells).alias("hi"), F.avg(cells).alias("mean"), (F.min(cells) == F.max(cells)).alias("regular"))


def in_sequence(rows: DataFrame, key: str, order: str, value: str, start: int = 0) -> DataFrame:
    """(key, ok): whether values rise from row to row, the first from ``start`` on."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_ok", F.col(value) > F.coalesce(before, F.lit(start - 1))).groupBy(key).agg(F.bool_and("_ok").alias("ok"))


def lost_and_gained(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(what, value): distinct values that only one side has."""
    a, b = old.select(F.col(column).alias("value")).distinct(), new.select(F.col(column).alias("value")).distinct()
    return a.join(b, "value", "left_anti").select(F.lit("lost").alias("what"), "value").unionByName(b.join(a, "value", "left_anti").select(F.lit("gained").alias("what"), "value"))


def revisions(rows: DataFrame, key: str, order: str, author: str) -> DataFrame:
    """revision: the number of each change of a document in time; author beside it."""
    return rows.select("*", F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("revision"), F.col(author).alias("author"))


def block_ids(rows: DataFrame, key: str, order: str, prefix: str = "b") -> DataFrame:
    """uid: prefix, document and place, so equal blocks stay apart."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("uid", F.concat(F.lit(prefix), F.col(key), F.lit("-"), place))


def issue_report(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, errors, warnings, json, text): all issues (level, rule, element) of a document as JSON and as lines."""
    own = F.sort_array(F.collect_list(F.struct("level", "rule", "element")))
    found = issues.groupBy(key).agg(own.alias("_i"))
    count = lambda level: F.size(F.filter("_i", lambda x: x["level"] == level))
    line = lambda x: F.concat(F.upper(x["level"]), F.lit(": "), x["rule"], F.lit(" ("), x["element"], F.lit(")"))
    return found.select(key, count("error").alias("errors"), count("warning").alias("warnings"), F.to_json("_i").alias("json"), F.array_join(F.transform("_i", line), "\n").alias("text"))


def package_issues(parts: DataFrame, relationships: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, rule, element): parts that are missing, parts without a content type, and internal relationships whose target part is not there.

    ``parts``: (key, part, content_type), ``relationships``: (key, source, rel_id, target, target_mode). Targets are taken relative to their source's folder.
    """
    own = gathered(key, parts=parts.select(key, "part", "content_type"), rels=relationships.select(key, "source", "rel_id", "target", "target_mode"))
    issue = lambda level, rule, element: f"struct('{level}' AS level, '{rule}' AS rule, {element} AS element)"
    missing = lambda names, level: f"transform(array_except(array({', '.join(repr(n) for n in names)}), parts.part), p -> {issue(level, 'missing_part', 'p')})"
    absent = f"if(size(parts) > 0, concat({missing(REQUIRED, 'error')}, {missing(OPTIONAL, 'warning')}), array())"
    untyped = f"transform(filter(parts, p -> p.content_type IS NULL AND p.part <> '{REQUIRED[0]}'), p -> {issue('warning', 'no_content_type', 'p.part')})"
    broken = f"transform(filter(rels, r -> coalesce(r.target_mode, 'Internal') <> 'External' AND NOT coalesce(array_contains(parts.part, {named('r.source', 'r.target')}), false)), r -> {issue('error', 'broken_target', 'r.rel_id')})"
    return own.select(key, F.inline(F.expr(f"concat({absent}, {untyped}, {broken})")))


def property_issues(properties: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rule, name): counts of application properties that are no whole number of 0 or more, and values without a name."""
    number = F.expr("try_cast(value AS bigint)")
    bad = F.when(F.col("name").isNull() | (F.col("name") == ""), "no_name").when(F.col("name").isin(*COUNTS) & (number.isNull() | (number < 0)), "bad_count")
    return properties.select(key, bad.alias("rule"), "name").filter(F.col("rule").isNotNull())


def document_stats(rows: DataFrame, properties: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of a document's elements beside the pages, words and characters that its application properties (key, name, value) tell."""
    counts = rows.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("paragraph", "table", "image")))
    told = properties.groupBy(key).agg(*(F.max(F.when(F.col("name") == n, F.expr("try_cast(value AS bigint)"))).alias(n.lower()) for n in ("Pages", "Words", "Characters")))
    return counts.join(told, key, "left")


def run_signatures(runs: DataFrame, *look: str, key: str = "doc_id") -> DataFrame:
    """(key, look, n, first): runs of one look, numbered by their first appearance; columns that say nothing are part of a look too."""
    found = runs.groupBy(key, *look).agg(F.count("*").alias("n"), F.min(F.struct("seq", "run")).alias("_first"))
    return found.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).drop("_first")


def unique_ids(rows: DataFrame, taken: DataFrame, prefix: str, order: str, key: str = "doc_id") -> DataFrame:
    """id of each row: prefix and a number from the largest taken one of that prefix on (``taken``: key, id)."""
    number = F.expr(f"try_cast(regexp_extract(id, '^{prefix}([0-9]+)$', 1) AS int)")
    above = taken.groupBy(key).agg(F.max(number).alias("_above"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(above, key, "left").withColumn("id", F.concat(F.lit(prefix), F.coalesce("_above", F.lit(0)) + place)).drop("_above")


def global_numbers(references: DataFrame, key: str = "doc_id") -> DataFrame:
    """number of each note over footnotes and endnotes alike, by first reference (key, seq, kind, note_id)."""
    first = references.groupBy(key, "kind", "note_id").agg(F.min("seq").alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("_first", "kind", "note_id"))).drop("_first")


def first_differences(left: DataFrame, right: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """The first ``n`` places of each document whose texts differ: (key, seq, old, new)."""
    pair = left.select(key, "seq", F.col("text").alias("old")).join(right.select(key, "seq", F.col("text").alias("new")), [key, "seq"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return pair.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).filter(F.col("_n") <= n).drop("_n")


def row_heights(cells: DataFrame, line: float, padding: float, key: str = "table_id") -> DataFrame:
    """(key, row, height, y): a row is as high as its cell of most lines (column ``lines``), and starts where the ones above end."""
    rows = cells.groupBy(key, "row").agg((F.max("lines") * line + 2 * padding).alias("height"))
    return rows.withColumn("y", F.sum("height").over(Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("height"))
