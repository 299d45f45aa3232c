"""Documents normalised: clean values, united runs, no local formatting that a style says anyway, and styles made of the local formatting that is left.

The text stays what it is, and a second pass changes nothing. Tables made here are larger than Spark takes them for, so joins say that none is to be broadcast. Inputs are tables of the package scan with the document's key; whatever depends on order works within a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina import scratch
from lamina.operators import styles as S

SWITCHES, LOOK = ("bold", "italic", "underline", "strike"), ("highlight", "color", "font_size", "font_name")
#: The run property that stands for each column of a run's look.
PROPERTY = {"bold": "b", "italic": "i", "underline": "u", "strike": "strike", "highlight": "highlight", "color": "color", "font_size": "sz", "font_name": "rFonts.ascii"}
PARAGRAPH_STYLE, RUN_STYLE = "Paragraph", "Run"


def clean(runs: DataFrame) -> DataFrame:
    """Values in one spelling: switches that are off, blank texts and `auto` say nothing, colours are six capital digits, sizes plain numbers, font names without blanks at their ends."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    color = F.upper(F.regexp_replace(F.trim("color"), "^#", ""))
    six = F.when(color.rlike("^[0-9A-F]{3}$"), F.regexp_replace(color, "(.)", "$1$1")).otherwise(color)
    size = F.expr("try_cast(trim(font_size) AS double)")
    return runs.withColumns(
        {c: F.when(F.col(c), F.lit(True)) for c in SWITCHES}
        | {"highlight": F.nullif(F.lower(blank("highlight")), F.lit("none")), "color": F.when(six != "AUTO", F.nullif(six, F.lit(""))), "font_name": blank("font_name")}
        | {"font_size": F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(blank("font_size"))}
    )


def united(runs: DataFrame, key: str = "doc_id", owners: DataFrame | None = None) -> DataFrame:
    """Neighbouring runs of a paragraph with one look are one run, numbered anew; fields and notes stay runs of their own, and empty runs without either go.

    Runs: (key, part, seq, place, run, text, look..., field, note), and a style if they have one. ``owners`` (key, part, seq, _theirs map): what a paragraph says for its runs without a style
    is dropped from their looks first. A paragraph's runs are gathered into one row, by one shuffle, and united there.
    """
    paragraph = [key, "part", "seq", "place"]
    look = [*SWITCHES, *LOOK, *(c for c in ("style",) if c in runs.columns)]
    kept = runs.filter("field IS NOT NULL OR note IS NOT NULL OR coalesce(text, '') <> ''")
    one = F.struct("run", F.coalesce("text", F.lit("")).alias("text"), F.struct(*look).alias("look"), "field", "note")
    own = scratch.dealt(kept, key, "seq").groupBy(*paragraph).agg(F.sort_array(F.collect_list(one)).alias("_runs"))
    if owners is not None:
        said = {c: f"NOT {f"if(r.look.{c}, 'true', NULL)" if c in SWITCHES else f'r.look.{c}'} <=> try_element_at(_theirs, '{p}')" for c, p in PROPERTY.items()}
        free = "r.look.style IS NOT NULL OR " if "style" in look else ""
        left = ", ".join(f"'{c}', if({free}{said[c]}, r.look.{c}, NULL)" if c in said else f"'{c}', r.look.{c}" for c in look)
        changed = F.expr(f"transform(_runs, r -> named_struct('run', r.run, 'text', r.text, 'look', named_struct({left}), 'field', r.field, 'note', r.note))")
        own = own.join(owners.hint("merge"), [key, "part", "seq"], "left").withColumn("_runs", F.when(F.col("_theirs").isNull(), F.col("_runs")).otherwise(changed))
    alone = lambda i: f"_runs[{i}].field IS NOT NULL OR _runs[{i}].note IS NOT NULL"
    own = own.withColumn("_starts", F.expr(f"filter(sequence(0, size(_runs) - 1), i -> i = 0 OR {alone('i')} OR {alone('i - 1')} OR NOT _runs[i].look <=> _runs[i - 1].look)"))
    text = "array_join(transform(sequence(s, coalesce(get(_starts, j + 1), size(_runs)) - 1), k -> _runs[k].text), '')"
    islands = f"transform(_starts, (s, j) -> struct(cast(j AS bigint) AS run, {text} AS text, _runs[s].look AS look, _runs[s].field AS field, _runs[s].note AS note))"
    return own.select(*paragraph, F.inline(F.expr(islands))).select(*(F.col(f"look.{c}").alias(c) if c in look else F.col(c) for c in runs.columns))


def said_anyway(rows: DataFrame, resolved: DataFrame, local: str = "properties", key: str = "doc_id") -> DataFrame:
    """``rows`` (key, style, ``local`` map) without the local entries that their style says, by itself or by what it is based on. Empty entries go too."""
    theirs = resolved.select(key, F.col("style_id").alias("style"), F.col("properties").alias("_theirs"))
    left = F.expr(f"map_filter(coalesce({local}, map()), (k, v) -> coalesce(v, '') <> '' AND NOT v <=> try_element_at(coalesce(_theirs, map()), k))")
    return rows.join(theirs.hint("merge"), [key, "style"], "left").withColumn(local, left).drop("_theirs")


def entries(properties: str) -> Column:
    """A map in one order, so that equal ones are equal."""
    return F.array_sort(F.map_entries(properties))


def synthesised(rows: DataFrame, styles: DataFrame, kind: str, prefix: str, key: str = "doc_id", style: str = "style", local: str = "properties", order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """(rows, styles): each signature (style, local properties) of a document becomes a style based on the one that rows had, and the rows have it instead.

    A style of ``kind`` with that base and just those properties serves if there is one, the least id of several; new ones are numbered by first use, above what the document has.
    """
    at = scratch.folder(rows.sparkSession)
    rows = scratch.written(rows.withColumn("_own", entries(local)), "rows", at)  # three tables come of them, each of which would make them anew
    used = rows.filter(F.size("_own") > 0).groupBy(key, F.col(style).alias("_base"), "_own").agg(F.min(F.struct(*order)).alias("_first"))
    there = styles.filter(F.col("type") == kind).groupBy(F.col(key).alias("_key"), F.col("based_on").alias("_on"), entries("properties").alias("_same")).agg(F.min("style_id").alias("_there"))
    met = used.join(there.hint("merge"), (F.col(key) == F.col("_key")) & F.col("_base").eqNullSafe(F.col("_on")) & (F.col("_own") == F.col("_same")), "left").drop("_key", "_on", "_same")
    number = F.expr(f"try_cast(regexp_extract(style_id, '^{prefix}([0-9]+)$', 1) AS int)")
    above = styles.groupBy(key).agg(F.max(number).alias("_above"))
    place = F.sum(F.col("_there").isNull().cast("int")).over(Window.partitionBy(key).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0))
    named = scratch.written(met.join(above.hint("merge"), key, "left").withColumn("_new", F.coalesce("_there", F.concat(F.lit(prefix), (F.coalesce("_above", F.lit(0)) + place).cast("string")))), "named", at)
    made = named.filter("_there IS NULL").select(key, F.col("_new").alias("style_id"), F.lit(kind).alias("type"), F.concat(F.lit("Normalised "), F.lower(F.col("_new"))).alias("name"), F.col("_base").alias("based_on"), F.map_from_entries("_own").alias("properties"))
    names = named.select(F.col(key).alias("_key"), F.col("_base").alias("_was"), F.col("_own").alias("_what"), "_new")
    out = rows.join(names.hint("merge"), (F.col(key) == F.col("_key")) & F.col(style).eqNullSafe(F.col("_was")) & (F.col("_own") == F.col("_what")), "left")
    out = out.withColumns({style: F.coalesce("_new", style), local: F.when(F.col("_new").isNull(), F.col(local)).otherwise(F.create_map().cast("map<string,string>"))})
    return out.drop("_own", "_key", "_was", "_what", "_new"), styles.unionByName(made.select(*styles.columns))


def used_only(styles: DataFrame, used: DataFrame, prefixes: tuple[str, ...] = (PARAGRAPH_STYLE, RUN_STYLE), key: str = "doc_id") -> DataFrame:
    """The document's styles without those made here that nothing uses any more. ``used``: (key, style_id), of rows; bases count as used."""
    made = F.col("style_id").rlike(f"^({'|'.join(prefixes)})[0-9]+$")
    every = used.unionByName(styles.select(key, F.col("based_on").alias("style_id"))).distinct().withColumn("_used", F.lit(True))
    return styles.join(every.hint("merge"), [key, "style_id"], "left").filter(~made | F.col("_used")).drop("_used")


def normalised(elements: DataFrame, runs: DataFrame, styles: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """elements, runs and styles of the documents, normalised.

    ``elements``: (key, part, seq, kind, style, properties, ...), of which paragraphs are changed; ``runs`` as in ``united``; ``styles``: (key, style_id, type, name, based_on, properties).
    In turn: runs get clean values; what a paragraph's style says for its runs or itself is no local formatting; equal neighbours become one run; signatures of paragraphs and of
    runs become styles. Paragraph properties that say where it stands in a list, and its style's name, are no formatting and stay.
    """
    resolved = S.resolved(styles, key)
    columns = elements.columns
    kept = ("pStyle", "numPr.ilvl", "numPr.numId")
    is_kept = lambda k: k.isin(*kept)
    is_paragraph = F.col("kind") == "paragraph"
    paragraphs = said_anyway(elements.filter(is_paragraph).withColumns({"_kept": F.map_filter("properties", lambda k, v: is_kept(k)), "properties": F.map_filter("properties", lambda k, v: ~is_kept(k))}), resolved, key=key)
    place = [c for c in ("part", "seq") if c in columns]
    paragraphs, styles = synthesised(paragraphs, styles, "paragraph", PARAGRAPH_STYLE, key, order=tuple(place))
    renamed = F.transform_values(F.coalesce("_kept", F.create_map().cast("map<string,string>")), lambda k, v: F.when(k == "pStyle", F.col("style")).otherwise(v))
    paragraphs = paragraphs.withColumn("properties", F.map_concat(renamed, F.coalesce("properties", F.create_map().cast("map<string,string>")))).select(*columns)

    pairs = F.filter(F.array(*(F.struct(F.lit(p).alias("key"), (F.when(F.col(c), F.lit("true")) if c in SWITCHES else F.col(c)).alias("value")) for c, p in PROPERTY.items())), lambda x: x["value"].isNotNull())
    looks = clean(runs if "style" in runs.columns else runs.withColumn("style", F.lit(None).cast("string")))
    # a run says nothing that its own style, or else its paragraph's, says
    if "style" in runs.columns:
        looks = said_anyway(looks.withColumn("_local", F.map_from_entries(pairs)), resolved, "_local", key)
        value = lambda c: F.try_element_at(F.col("_local"), F.lit(PROPERTY[c]))
        looks = looks.withColumns({c: (value(c) == "true") if c in SWITCHES else value(c) for c in PROPERTY}).drop("_local")
    else:
        looks = looks.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in LOOK})
    owner = elements.filter(is_paragraph).select(key, *place, F.col("style").alias("_paragraph")).distinct()
    theirs = resolved.select(key, F.col("style_id").alias("_paragraph"), F.col("properties").alias("_theirs"))
    owner = owner.join(theirs.hint("merge"), [key, "_paragraph"]).select(key, *place, "_theirs")
    whole = united(looks, key, owner).withColumn("_local", F.map_from_entries(pairs))
    whole, styles = synthesised(whole, styles, "character", RUN_STYLE, key, local="_local", order=("part", "seq", "place", "run"))
    bare = {c: F.when(F.size("_local") > 0, F.col(c)) for c in PROPERTY}
    whole = whole.withColumns(bare).drop("_local")
    used = paragraphs.select(key, F.col("style").alias("style_id")).unionByName(whole.select(key, F.col("style").alias("style_id")))
    return {"elements": paragraphs.unionByName(elements.filter(~F.coalesce(is_paragraph, F.lit(False)))), "runs": whole, "styles": used_only(styles, used, key=key)}
