"""Styles, references and template data: inheritance, overlays, lookups and dangling references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import scratch
from lamina.functions import text

def walked(rows: DataFrame, key: str, more: Column, ends: Callable[[int], Column]) -> DataFrame:
    """``rows`` (key, style_id, value, at) with what follows at ``at`` taken into ``value`` until nothing does: by doubling, so rounds number the logarithm of the longest chain.

    ``more`` makes the new value of ``value`` and ``_value``, that of the style at ``at``; ``ends`` says, by the styles walked so far, where a chain goes on no further than ``_at``.
    Each round joins the open chains alone, and leaves a table of them; every style is a row of its own, so a document of any size is spread over all tasks.
    """
    folder = scratch.folder(rows.sparkSession)
    found = scratch.written(scratch.dealt(rows, key, "style_id"), "round-0", folder)
    whole, going, steps = found.filter("at IS NULL"), found.filter("at IS NOT NULL"), 1
    while not going.isEmpty():
        steps *= 2
        there = whole.unionByName(going).select(key, F.col("style_id").alias("at"), F.col("value").alias("_value"), F.col("at").alias("_at"))
        # paths are small in a file and large in memory: nothing of them may be broadcast
        met = going.join(there.hint("merge"), [key, "at"], "left").withColumn("value", more)
        found = scratch.written(met.select(key, "style_id", "value", F.when(~ends(steps), F.col("_at")).alias("at")), f"round-{steps}", folder)
        whole, going = whole.unionByName(found.filter("at IS NULL")), found.filter("at IS NOT NULL")
    return whole


def chains(styles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, style_id, ancestor, depth): each style of a document with itself and what it is based on, leaf first.

    A chain is as long as it is; it ends at a style that isn't there, and a cycle where it closes. Of repeated style ids the least base counts.
    """
    one = styles.groupBy(key, "style_id").agg(F.min("based_on").alias("at"))
    start = one.select(key, "style_id", F.array("style_id").alias("value"), F.when(F.col("at") != F.col("style_id"), F.col("at")).alias("at"))
    path = F.array_distinct(F.concat("value", F.coalesce("_value", F.array().cast("array<string>"))))  # the first of equal ones stays: the nearest
    out = walked(start, key, path, lambda steps: F.coalesce(F.array_contains("value", F.col("_at")), F.lit(True)))
    return out.select(key, "style_id", F.posexplode("value").alias("depth", "ancestor")).select(key, "style_id", "ancestor", "depth")


def resolved(styles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, style_id, properties): those of the whole chain, nearer styles over farther ones. Of repeated style ids the least base counts, with its properties.

    A chain round a cycle says nothing new after as many steps as the largest document has styles. Styles without any property have no row.
    """
    one = styles.groupBy(key, "style_id").agg(F.min(F.struct("based_on", F.array_sort(F.map_entries("properties")).alias("properties"))).alias("s"))
    start = one.select(key, "style_id", F.map_from_entries(F.coalesce("s.properties", F.expr("array()").cast("array<struct<key:string,value:string>>"))).alias("value"), F.when(F.col("s.based_on") != F.col("style_id"), F.col("s.based_on")).alias("at"))
    most: list[int] = []

    def ends(steps: int) -> Column:
        if steps >= LONG and not most:  # only long chains and cycles come that far
            most.append(styles.groupBy(key).agg(F.count_distinct("style_id").alias("n")).agg(F.max("n")).first()[0])
        return F.lit(bool(most) and steps >= most[0])

    farther = F.expr("map_filter(coalesce(_value, map()), (k, v) -> NOT map_contains_key(value, k))")
    out = walked(start, key, F.map_concat("value", farther), ends)
    return out.filter(F.size("value") > 0).select(key, "style_id", F.map_from_entries(F.array_sort(F.map_entries("value"))).alias("properties"))


#: Steps of a chain from which on it is asked how many styles a document can have.
LONG = 64


def inherited(based: dict[str, str | None], own: dict[str, dict]) -> dict[str, dict]:
    """What ``resolved`` gives for one document, in plain Python: the properties of each style over those of its chain. A base is resolved once for all styles on it; only the members of a cycle walk their own way round."""
    done: dict[str, dict] = {}
    for style in based:
        path, at = {}, style
        while at in based and at not in done and at not in path:
            path[at] = len(path)
            at = based[at]
        ring = [s for s in path if at in path and path[s] >= path[at]]
        for i, s in enumerate(ring):
            whole: dict = {}
            for a in reversed(ring[i:] + ring[:i]):
                whole |= own[a]
            done[s] = whole
        for s in reversed(path):
            if s not in done:
                done[s] = done.get(based[s], {}) | own[s]
    return done


def cascaded(*layers: str) -> Column:
    """Maps on one another, the last on top, null and empty values skipped: theme, referenced style with its bases, local."""
    out = f"coalesce({layers[0]}, map())"
    for layer in layers[1:]:
        out = f"map_filter(map_zip_with({out}, coalesce({layer}, map()), (k, x, y) -> coalesce(nullif(y, ''), x)), (k, v) -> v IS NOT NULL)"
    return F.expr(out)


def overlay(base: str, over: str, skip_empty: bool = True) -> Column:
    """Map ``over`` on map ``base``; null and empty values of ``over`` are skipped if asked."""
    y = "coalesce(nullif(y, ''), x)" if skip_empty else f"if(map_contains_key({over}, k), y, x)"
    return F.expr(f"map_zip_with({base}, {over}, (k, x, y) -> {y})")


def without_defaults(local: str, definition: str, *keep: str) -> Column:
    """Local entries that differ from the definition's; ``keep`` stay anyway."""
    names = ", ".join(f"'{k}'" for k in keep) or "''"
    return F.expr(f"map_filter({local}, (k, v) -> k IN ({names}) OR NOT v <=> element_at({definition}, k))")


def pruned(style: str) -> Column:
    return F.expr(f"map_filter({style}, (k, v) -> coalesce(v, '') NOT IN ('', 'false', '[]', '{{}}'))")


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """Rows whose reference has no target in their own document."""
    return rows.filter(F.col(column).isNotNull()).join(targets.select(key, F.col(target).alias(column)).distinct(), [key, column], "left_anti")


def placeholders(templates: DataFrame, column: str = "text") -> DataFrame:
    """Every placeholder of each row with its place among them, type and key."""
    names = templates.select("*", F.posexplode(F.expr(text.placeholder_names(column))).alias("position", "name"))
    return names.withColumns({"type": F.expr(text.placeholder_type("name")), "key": F.expr(text.placeholder_key("name"))})


def filled(rows: DataFrame, template: str, values: dict[str, str]) -> Column:
    """``template`` with every spelling of every key replaced by its expression; keys without a value stay as they are; a null value is the empty text.

    Nested replace() calls stay in generated code, whatever the number of keys.
    """
    out = template
    for key, value in values.items():
        bare = key.partition(":")[2] if ":" in key else None
        for name in filter(None, (key, bare)):
            for a, b in (("{{ ", " }}"), ("{{ ", "}}"), ("{{", " }}"), ("{{", "}}"), ("{ ", " }"), ("{", "}")):
                out = f"replace({out}, '{a}{name}{b}', coalesce({value}, ''))"
    return F.expr(out)


def lookup(rows: DataFrame, column: str, table: DataFrame, key: str, *take: str) -> DataFrame:
    """Left equi-join for relationship, numbering and media lookups; Spark broadcasts the table where its size allows."""
    return rows.join(table.select(F.col(key).alias(column), *take), column, "left")


def deep_merged(base: str, over: str, skip_empty: bool = True) -> Column:
    """Maps of maps (`font` -> `size` -> text) merged at both depths; null and empty values of ``over`` are skipped if asked."""
    inner = "coalesce(nullif(b, ''), a)" if skip_empty else "if(map_contains_key(coalesce(y, map()), j), b, a)"
    return F.expr(f"map_zip_with(coalesce({base}, map()), coalesce({over}, map()), (k, x, y) -> map_filter(map_zip_with(coalesce(x, map()), coalesce(y, map()), (j, a, b) -> {inner}), (j, v) -> {'v IS NOT NULL' if skip_empty else 'true'}))")
