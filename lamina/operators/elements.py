"""Elements of documents as rows (doc_id, seq, kind, text, ...): projections, search, statistics, order and counters.

Rows carry ``seq``; whatever depends on order partitions by document and orders by it, so documents are the unit of parallelism.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import formats, text


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, text): a line is a paragraph."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def with_kinds(rows: DataFrame) -> DataFrame:
    """Gives rows of plain text a kind by their place, so that structure operators have something to count."""
    return rows.withColumn("kind", F.when(F.col("seq") % 5 == 3, "table").when(F.col("seq") % 7 == 5, "image").otherwise("paragraph"))


def joined_text(rows: DataFrame, separator: str = "\n", key: str = "doc_id") -> DataFrame:
    """(key, text): the non-empty texts of a key in order. One document's rows meet, no more."""
    own = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["text"]), separator).alias("text"))


def search(rows: DataFrame, needle: str, around: int = 50, case_sensitive: bool = False) -> DataFrame:
    """A row for each match that doesn't overlap the one before: start, end (from 0) and up to ``around`` characters on both sides.

    Without case, letters match as the rules of Unicode fold them, one for one; places are those of the text as it is.
    """
    pattern = ("" if case_sensitive else "(?iu)") + f"\\Q{needle}\\E"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    spans = F.arrays_zip(F.transform(F.split("text", pattern, -1), F.char_length).alias("gap"), F.transform(found, F.char_length).alias("length"))
    steps = rows.filter(F.col("text").rlike(pattern)).withColumn("_spans", F.filter(spans, lambda x: x["length"].isNotNull()))
    ends = steps.withColumn("_ends", F.expr(text.running("transform(_spans, x -> x.gap + x.length)")))
    hits = ends.withColumn("_hit", F.explode(F.arrays_zip("_ends", "_spans"))).withColumn("end", F.col("_hit._ends")).withColumn("start", F.col("end") - F.col("_hit._spans.length")).drop("_spans", "_ends", "_hit")
    low = F.greatest(F.col("start") - around, F.lit(0))
    return hits.withColumn("context", F.substring("text", low + 1, F.col("end") + around - low))


def replace(rows: DataFrame, needle: str, by: str, case_sensitive: bool = True) -> DataFrame:
    """text with every occurrence replaced, and n, how many there were."""
    hay = F.col("text") if case_sensitive else F.lower("text")
    word = needle if case_sensitive else needle.lower()
    pattern = ("" if case_sensitive else "(?iu)") + f"\\Q{needle}\\E"
    n = F.size(F.split(hay, f"\\Q{word}\\E", -1)) - 1
    return rows.withColumns({"n": n, "text": F.regexp_replace("text", pattern, by.replace("\\", "\\\\").replace("$", "\\$"))})


def paths(rows: DataFrame) -> DataFrame:
    """path like body.paragraph[2]: the place among rows of one kind."""
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("seq")) - 1
    return rows.withColumn("path", F.format_string("body.%s[%d]", "kind", place))


def structure(rows: DataFrame) -> DataFrame:
    """Counts, densities, the kind that dominates, the type and the complexity of each document, in one aggregation with a map-side part.

    Complexity adds the scores of the tables (column ``score`` of their rows, see ``tables.structure``; none: 0) to a step of the number of elements.
    """
    kinds = ("paragraph", "table", "image")
    score = F.coalesce(F.sum(F.when(F.col("kind") == "table", F.col("score"))), F.lit(0)) if "score" in rows.columns else F.lit(0)
    n = {k: F.count_if(F.col("kind") == k) for k in kinds}
    out = rows.groupBy("doc_id").agg(F.count("*").alias("total"), *(n[k].alias(f"{k}s") for k in kinds), F.count_if(F.col("kind") == "textbox").alias("textboxes"), score.alias("table_score"), F.sum(F.char_length("text")).alias("characters"))
    top = F.greatest("paragraphs", "tables", "images")
    balance = F.when(F.col("paragraphs") == top, "text_heavy").when(F.col("tables") == top, "table_heavy").when(F.col("images") == top, "image_heavy")
    size = F.when(F.col("total") > 50, 3).when(F.col("total") > 20, 2).when(F.col("total") > 10, 1).otherwise(0)
    score = size + F.col("table_score")
    return out.withColumns({
        **{f"{k}_density": F.col(f"{k}s") / F.col("total") for k in kinds},
        "balance": balance,
        "doc_type": F.when(F.col("tables") > F.col("paragraphs"), "table_heavy").when(F.col("images") > F.col("paragraphs"), "image_heavy").when(F.col("textboxes") > 0, "mixed_layout").when(F.col("paragraphs") > 10, "text_heavy").otherwise("simple"),
        "complexity": F.when(score >= 10, "high").when(score >= 5, "medium").otherwise("low"),
    })


def reading_order(rows: DataFrame) -> DataFrame:
    """position: by priority of the kind, then y, x and the document's own order."""
    priority = F.when(F.col("kind") == "paragraph", 1).when(F.col("kind") == "table", 2).when(F.col("kind") == "image", 3).when(F.col("kind") == "textbox", 4).otherwise(5)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(priority, "y", "x", "seq")))


def flat_counters(items: DataFrame, start: Column | int = 1) -> DataFrame:
    """counter of each list item, by (num_id, level) alone: shallower items don't restart it."""
    own = Window.partitionBy("doc_id", "num_id", "level").orderBy("seq")
    return items.withColumn("counter", F.row_number().over(own) + F.lit(start) - 1)


def scoped_counters(items: DataFrame, depth: int = 10, start: Column | int = 1) -> DataFrame:
    """counter that restarts below each parent, the last item before of a shallower level; parent_seq says which.

    The first item of a scope takes ``start``. Levels from ``depth`` - 1 on share that one's parent.
    """
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shallower = [F.last(F.when(F.col("level") < k, F.col("seq")), ignorenulls=True).over(before) for k in range(depth)]
    parent = F.coalesce(*(F.when(F.least(F.col("level"), F.lit(depth - 1)) == k, shallower[k]) for k in range(1, depth)))
    items = items.withColumn("parent_seq", parent)
    own = Window.partitionBy("doc_id", "num_id", "level", "parent_seq").orderBy("seq")
    return items.withColumn("counter", F.row_number().over(own) + F.lit(start) - 1)


def continued(items: DataFrame, restart: str) -> DataFrame:
    """counter of (num_id, level) that goes on through the document and starts again where ``restart`` is true."""
    own = Window.partitionBy("doc_id", "num_id", "level").orderBy("seq")
    items = items.withColumn("_part", F.count_if(F.col(restart)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "num_id", "level", "_part").orderBy("seq"))
    return items.withColumn("counter", place).drop("_part")


def rewound(items: DataFrame, hidden: str) -> DataFrame:
    """counter where items marked ``hidden`` take none."""
    own = Window.partitionBy("doc_id", "num_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("counter", F.sum(F.when(F.col(hidden), 0).otherwise(1)).over(own))


def islands(rows: DataFrame, *same: str) -> DataFrame:
    """Neighbours with equal ``same`` columns become one row: first and last seq, n and the joined text."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    style = F.struct(*same)
    rows = rows.withColumn("_new", F.when(F.lag(style).over(order).eqNullSafe(style), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy("doc_id", "island", *same).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.array_join(F.transform(own, lambda x: x["text"]), "").alias("text"))


def note_numbers(references: DataFrame) -> DataFrame:
    """number of each note by its first reference in the document."""
    first = references.groupBy("doc_id", "note_id").agg(F.min("seq").alias("first_seq"))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_seq", "note_id")))


def style_dictionary(rows: DataFrame, *style: str) -> DataFrame:
    """style_id: styles of a document numbered from 0 by first appearance."""
    key = F.md5(F.to_json(F.struct(*style)))
    first = Window.partitionBy("doc_id", *style)
    rows = rows.withColumn("style_hash", key).withColumn("_first", F.min("seq").over(first))
    return rows.withColumn("style_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first")) - 1).drop("_first")


def wrapped(rows: DataFrame, width: int = 80) -> DataFrame:
    return rows.withColumn("wrapped", F.expr(text.wrap("text", width)))


def paginated(blocks: DataFrame, top: float = 25.4, usable: float = 246.2) -> DataFrame:
    """page and y of each block (column h in millimetres): a block that doesn't fit under the ones before it opens a page, even an empty one.

    An ordered pass over one document's heights, in time linear in them; the texts stay out of it.
    """
    heights = F.transform(F.sort_array(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"])

    @F.pandas_udf("array<struct<page:int,y:double>>")
    def places(documents: pd.Series) -> pd.Series:
        out = []
        for own in documents:
            page, y, rows = 1, top, []
            for h in own:
                if y + h > top + usable:
                    page, y = page + 1, top
                rows.append({"page": page, "y": y})
                y += h
            out.append(rows)
        return pd.Series(out, dtype=object)

    folded = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list("seq")).alias("seqs"), heights.alias("heights"))
    return folded.select("doc_id", F.inline(F.arrays_zip("seqs", places("heights").alias("places")))).select("doc_id", F.col("seqs").alias("seq"), "places.page", "places.y")


def with_heights(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.expr(formats.block_height("kind", "text", "2", "CAST(NULL AS double)")).cast("double"))


def gaps(placed: DataFrame) -> DataFrame:
    """gap to the block before on the page; a negative one is an overlap."""
    before = F.lag(F.col("y") + F.col("h")).over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return placed.withColumn("gap", F.col("y") - before)


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged(target: DataFrame, source: DataFrame, prepend: bool = False) -> DataFrame:
    """Rows of both documents with a new seq: the source's paragraphs, then its tables, behind the target; or in front of it, reversed."""
    part = F.when(F.col("kind") == "paragraph", 0).otherwise(1)
    own = source.filter(F.col("kind").isin("paragraph", "table"))
    marked = all_of(target.withColumns({"_side": F.lit(1), "_part": F.lit(0), "_at": F.col("seq")}), own.withColumns({"_side": F.lit(0 if prepend else 2), "_part": -part if prepend else part, "_at": -F.col("seq") if prepend else F.col("seq")}))
    return marked.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("_side", "_part", "_at")) - 1).drop("_side", "_part", "_at")


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows at equal places side by side: which text was changed, added or kept."""
    pair = left.select("doc_id", "seq", F.col("text").alias("old")).join(right.select("doc_id", "seq", F.col("text").alias("new")), ["doc_id", "seq"], "full_outer")
    return pair.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "untouched").when(F.col("old") == F.col("new"), "same").otherwise("changed"))


def issues(rows: DataFrame, **rules: Column) -> DataFrame:
    """(doc_id, seq, rule): one row for each rule that a row breaks, in one pass over the rows."""
    found = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return rows.select("doc_id", "seq", F.explode(found).alias("rule"))


def updated(body: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, seq, text, change): the i-th paragraph takes the i-th parsed text, further parsed ones are appended, surplus paragraphs stay."""
    pair = positional(body, parsed)
    return pair.select("doc_id", "seq", F.coalesce("new", "old").alias("text"), "change")


def built(rows: DataFrame, styles: DataFrame, levels: DataFrame) -> DataFrame:
    """Elements with the style's properties and the numbering level's format and template beside them: (…, place, properties, format, template).

    ``styles``: (doc_id, style_id, properties), resolved; ``levels``: (doc_id, num_id, level, format, template). Place is header, footer or body, from the part.
    """
    place = F.when(F.col("part").startswith("header"), "header").when(F.col("part").startswith("footer"), "footer").otherwise("body")
    own = rows.withColumn("place", place).join(styles.select("doc_id", F.col("style_id").alias("style"), "properties"), ["doc_id", "style"], "left")
    return own.join(levels.select("doc_id", "num_id", "level", "format", "template"), ["doc_id", "num_id", "level"], "left")
