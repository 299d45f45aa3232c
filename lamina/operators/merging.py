"""Documents and styles put together: many documents in order, styles with renamed conflicts, replaced parts, cycles and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import styles as S


def merged_in_order(rows: DataFrame, group: str) -> DataFrame:
    """(group, doc_id, kind, text, seq): the rows of each group's documents behind each other by doc_id, a page break between two."""
    starts = rows.groupBy(group, "doc_id").agg(F.min("seq").alias("seq"))
    first = F.row_number().over(Window.partitionBy(group).orderBy("doc_id")) > 1
    breaks = starts.withColumn("_later", first).filter("_later").select(group, "doc_id", F.lit("page_break").alias("kind"), F.lit("").alias("text"), F.lit(-1).alias("_at"))
    own = rows.select(group, "doc_id", "kind", "text", F.col("seq").alias("_at"))
    order = Window.partitionBy(group).orderBy("doc_id", "_at")
    return own.unionByName(breaks).withColumn("seq", F.row_number().over(order) - 1).drop("_at")


def styles_merged(target: DataFrame, source: DataFrame, suffix: str = "_merged", key: str = "doc_id") -> DataFrame:
    """Styles of both sides of each document; a source style whose id the target has gets a new id, old_id tells which it was, and what is based on it follows (column ``based_on``)."""
    taken = target.select(key, "style_id").distinct().withColumn("_taken", F.lit(True))
    new = lambda c: F.concat(c, F.lit(suffix))
    own = source.join(taken, [key, "style_id"], "left").withColumn("old_id", F.col("style_id"))
    own = own.withColumn("style_id", F.when(F.col("_taken"), new("style_id")).otherwise(F.col("style_id"))).drop("_taken")
    if "based_on" in source.columns:
        moved = source.select(key, "style_id").distinct().join(taken, [key, "style_id"]).withColumnRenamed("style_id", "based_on")
        own = own.join(moved, [key, "based_on"], "left").withColumn("based_on", F.when(F.col("_taken"), new("based_on")).otherwise(F.col("based_on"))).drop("_taken")
    return target.withColumn("old_id", F.col("style_id")).unionByName(own)


def selected(target: DataFrame, source: DataFrame, parts: tuple[str, ...], part: str = "part") -> DataFrame:
    """Rows of the target, and those of the source whose part is asked for (body, tables, images, styles, headers): for ``parts`` with replacing rules the target's go."""
    replaced_parts = [p for p in parts if p in ("headers", "footers")]
    return target.filter(~F.col(part).isin(*replaced_parts) if replaced_parts else F.lit(True)).unionByName(source.filter(F.col(part).isin(*parts)))


def sections_merged(target: DataFrame, source: DataFrame, *fields: str, key: str = "doc_id") -> DataFrame:
    """The target's sections; its first one (section 0) takes the source's first one's fields where those say something."""
    first = source.filter("section = 0").select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = target.join(first, key, "left")
    return joined.select(*(F.when(F.col("section") == 0, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns))


def media_merged(target: DataFrame, source: DataFrame, used: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rel_id, target, new_id): the target's media, and the source's that its content uses (``used``: key, rel_id), numbered on from the target's largest id."""
    own = source.join(used.select(key, "rel_id").distinct(), [key, "rel_id"], "left_semi")
    number = F.expr("try_cast(regexp_extract(rel_id, '([0-9]+)$', 1) AS int)")
    above = target.groupBy(key).agg(F.max(number).alias("_above"))
    moved = new_ids(own.join(above, key, "left"), key, "rel_id", "_above")
    return target.select(key, "rel_id", "target", F.col("rel_id").alias("new_id")).unionByName(moved.select(key, "rel_id", "target", "new_id"))


def replaced(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the source's entries over the target's, as headers and footers of a type are."""
    own = source.select(key, F.col(value).alias("_new"))
    return target.select(key, value).join(own, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def remapped(rows: DataFrame, column: str, mapping: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """``column`` with a document's old ids replaced by its new ones (``mapping``: key, old, new); ids that its mapping lacks stay."""
    pairs = mapping.select(key, F.col(old).alias(column), F.col(new).alias("_new"))
    return rows.join(pairs, [key, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def new_ids(parts: DataFrame, key: str, order: str, above: str, prefix: str = "rId") -> DataFrame:
    """new_id of each part, counted on from the largest number that its target has already (column ``above``)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return parts.withColumn("new_id", F.concat(F.lit(prefix), F.coalesce(F.col(above), F.lit(0)) + place))


def cycles(styles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, style_id, depth, cyclic): length of each style's chain and whether its last member leads back into it."""
    chain = S.chains(styles, key).groupBy(key, "style_id").agg(F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("_last"), F.collect_set("ancestor").alias("_all"))
    last = styles.select(key, F.col("style_id").alias("_last"), F.col("based_on").alias("_next"))
    return chain.join(last, [key, "_last"]).select(key, "style_id", "depth", F.coalesce(F.array_contains("_all", F.col("_next")), F.lit(False)).alias("cyclic"))


def unused(styles: DataFrame, used: DataFrame, built_in: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """(key, style_id) of a document's styles that none of its rows uses and that aren't built in."""
    own = styles.select(key, "style_id").distinct()
    return (own.filter(~F.col("style_id").isin(*built_in)) if built_in else own).join(used.select(key, "style_id").distinct(), [key, "style_id"], "left_anti")
