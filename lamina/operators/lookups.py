"""Filters and lookups over element, style, relationship, media and table rows. Each is a predicate that reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The category of each kind of element; kinds that are not listed are structural. Kinds of this library's own scans are beside those that they stand for.
CATEGORIES = {
    "text": ("paragraph", "run", "text", "field", "hyperlink", "heading", "list_item"),
    "table": ("table", "table_row", "table_cell", "row", "cell"),
    "graphical": ("image", "textbox", "shape", "smartart", "chart", "drawing", "picture"),
    "layout": ("header", "footer", "footnote", "endnote"),
    "meta": ("comment", "bookmark", "controlbox"),
    "style": ("style_ref", "relation_ref", "numbering", "metadata_ref"),
}


def by_style(rows: DataFrame, name: str) -> DataFrame:
    """Elements of a style; cells and the content of text boxes are rows of their own and found alike."""
    return rows.filter(F.col("style") == name)


def of_type(rows: DataFrame, kind: str | Column, column: str = "type") -> DataFrame:
    """Rows of one type: styles, media, custom properties."""
    return rows.filter(F.col(column) == kind)


def first_named(rows: DataFrame, name: str, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The first row of each document with that name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.filter(F.col("name") == name).withColumn("_place", place).filter("_place = 1").drop("_place")


def relationships_of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("type") == kind)


def image_relationships(rows: DataFrame) -> DataFrame:
    """Image relationships of the document part, its headers and its footers."""
    return rows.filter((F.col("type") == "image") & F.col("source").rlike(r"(^|/)(document|header[0-9]*|footer[0-9]*)(\.xml)?$"))


def sized(rows: DataFrame, least: float = 0, most: float | None = None, column: str = "size") -> DataFrame:
    """Rows whose size lies between both bounds, the upper one open if there is none."""
    own = rows.filter(F.col(column) >= least)
    return own if most is None else own.filter(F.col(column) <= most)


def of_level(issues: DataFrame, *levels: str) -> DataFrame:
    return issues.filter(F.col("level").isin(*levels))


def category(kind: str = "kind") -> Column:
    """text, table, graphical, layout, meta, style or structural."""
    out = F.lit("structural")
    for name, kinds in CATEGORIES.items():
        out = F.when(F.col(kind).isin(*kinds), name).otherwise(out)
    return out


def inside(rows: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """Everything below a container, at any depth, in document order of ``seq``: paths say what lies in what."""
    own = rows.filter(F.col("path").startswith(f"{path}."))
    return own if kind is None else own.filter(F.col("kind") == kind)


def by_id(rows: DataFrame, value: str, column: str = "id") -> DataFrame:
    return rows.filter(F.col(column) == value)


def between(rows: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """Rows of a span of time, both ends included: comments and revisions by date."""
    return rows.filter(F.col(column).between(first, last))


def links(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, pos, link): the targets of a page's links in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(column, F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))


def hyperlinks(elements: DataFrame, relationships: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, seq, place, text, target, type, external, tooltip): the links of bodies, headers and footers with what they lead to.

    A link's relationship is its own part's; an anchor is `#name`. One whose relationship isn't there has no target.
    """
    own = elements.filter("kind = 'hyperlink'").select(key, "part", "seq", "place", "text", "rel_id", F.col("style").alias("_anchor"), F.try_element_at(F.col("properties"), F.lit("tooltip")).alias("tooltip"))
    rels = relationships.select(key, F.regexp_replace(F.regexp_replace("source", "^word/", ""), r"\.xml$", "").alias("part"), "rel_id", F.col("target").alias("_target"), (F.coalesce("target_mode", F.lit("Internal")) == "External").alias("_external"))
    found = own.join(rels, [key, "part", "rel_id"], "left")
    target = F.when(F.col("_anchor").isNull(), F.col("_target")).otherwise(F.concat(F.coalesce("_target", F.lit("")), F.lit("#"), F.col("_anchor")))
    found = found.withColumn("target", target)
    return found.select(key, "part", "seq", "place", "text", "target", F.when(F.col("target").isNotNull(), link_target("target")).alias("type"), F.coalesce("_external", F.lit(False)).alias("external"), "tooltip")


def link_target(url: str) -> Column:
    """anchor, email, url or file."""
    u = F.col(url)
    return F.when(u.startswith("#"), "anchor").when(u.startswith("mailto:"), "email").when(u.rlike("^https?://"), "url").otherwise("file")


def is_external(url: str) -> Column:
    return F.col(url).rlike("^[a-z]+://[^/]+")
