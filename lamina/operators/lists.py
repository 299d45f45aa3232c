"""Indents of lists by windows: open levels add up, the first paragraph of a marker sets the later ones, near lefts become their median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import formats

SIDES = ("left", "right", "first_line", "hanging")
#: Points (fixed values): the least width of a marker, a character's share of it, what is left free behind it, and how far lefts may lie from their median.
MARKER_LEAST, MARKER_CHARACTER, MARKER_FREE, NEAR = 6.0, 6.0, 3.0, 9.0
LEVELS = 9


def combined(own: str, level: str, style: str) -> Column:
    """One side of an indent: the paragraph's if it isn't zero, else the level's, else the style's."""
    return F.coalesce(F.nullif(own, F.lit(0.0)), level, style, F.lit(0.0))


def indented(items: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, seq, mode, text_start, number_start, left, right, first_line, hanging): effective indents in points.

    ``items`` are the paragraphs (doc_id, seq, num_id, level, marker, left, right, first_line, hanging, explicit, style_is_list and the four
    sides of the style with the prefix style_), ``levels`` the definitions (num_id, level, four sides, text, format, overridden), one a level.

    A numbered paragraph lies within the levels of its list that are open above it: level k is open if the last item before at level k or above
    has level k. Their sides add up. The sides of an ``explicit`` paragraph replace them where they aren't zero. The first paragraph of a document with a marker
    token at a level sets all later ones that aren't explicit (mode auto-match); the others are auto, or manual where the level is overridden. A paragraph in a list style
    without a number continues the last numbered one's sides; any other one has its style's. A hanging indent beats one of the first line. Where no side is
    explicit and the mode isn't manual, left and hanging make room for the marker, and lefts within NEAR of the median of their list and level become it.
    Nulls count as zero or false. Only windows over one document's rows, without their texts.
    """
    own = levels.select("num_id", "level", *(F.coalesce(F.col(s), F.lit(0.0)).alias(f"d_{s}") for s in SIDES), F.col("text").alias("level_text"), "overridden")
    rows = items.withColumn("level", F.when(F.col("num_id").isNotNull(), F.coalesce("level", F.lit(0)))).join(own, ["num_id", "level"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("explicit", "style_is_list", "overridden")})
    rows = rows.withColumns({f"{p}{s}": F.coalesce(f"{p}{s}", F.lit(0.0)) for p in ("", "style_", "d_") for s in SIDES} | {"mark": F.coalesce(F.nullif("marker", F.lit("")), "level_text", F.lit(""))})
    before = Window.partitionBy("doc_id", "num_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = F.col("num_id").isNotNull()
    # sides of each open level, of the item that opened it
    for k in range(LEVELS - 1):
        last = F.last(F.when(F.col("level") <= k, F.struct("level", *(f"d_{s}" for s in SIDES))), ignorenulls=True).over(before)
        rows = rows.withColumn(f"open_{k}", F.when((F.col("level") > k) & (last["level"] == k), last))
    none = F.lit(0.0)
    whole = {s: sum((F.coalesce(F.col(f"open_{k}")[f"d_{s}"], none) for k in range(LEVELS - 1)), F.col(f"d_{s}")) for s in SIDES}
    rows = rows.withColumns({f"w_{s}": whole[s] for s in SIDES} | {"token": F.expr(formats.marker_token("mark"))}).drop(*(f"open_{k}" for k in range(LEVELS - 1)))
    earlier = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when(numbered, F.struct(*(f"w_{s}" for s in SIDES))), ignorenulls=True).over(earlier)
    rows = rows.withColumn("current", current)
    first = Window.partitionBy("doc_id", "token", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    alike = numbered & (F.col("token") != "") & (F.row_number().over(Window.partitionBy("doc_id", "token", "level").orderBy("seq")) > 1)
    base = {s: F.when(numbered, F.col(f"w_{s}")).when(F.col("style_is_list") & F.col("current").isNotNull(), F.col("current")[f"w_{s}"]).otherwise(F.col(f"style_{s}")) for s in SIDES}
    free = F.col("explicit") | ~(numbered | F.col("style_is_list"))
    rows = rows.withColumn("alike", alike).withColumns({f"x_{s}": F.when(free, F.coalesce(F.nullif(s, none), base[s])).otherwise(base[s]) for s in SIDES})
    rows = rows.withColumns({f"f_{s}": F.first(f"x_{s}").over(first) for s in SIDES})
    rows = rows.withColumns({f"x_{s}": F.when(F.col("alike") & ~F.col("explicit"), F.col(f"f_{s}")).otherwise(F.col(f"x_{s}")) for s in SIDES})
    mode = F.when(F.col("alike"), "auto-match").when(numbered & F.col("overridden"), "manual").when(numbered, "auto").when(F.col("style_is_list") & F.col("current").isNotNull(), "continuation").when(F.col("style_is_list"), "manual").otherwise("none")
    rows = rows.withColumn("mode", mode)
    automatic = F.col("mode").isin("auto", "auto-match", "continuation") & ~F.col("explicit")
    short = F.greatest(F.char_length(F.trim("mark")) * MARKER_CHARACTER, F.lit(MARKER_LEAST)) + MARKER_FREE - F.col("x_hanging")
    rows = rows.withColumn("room", F.when(automatic & (short > 0), short).otherwise(none)).withColumns({"x_left": F.col("x_left") + F.col("room"), "x_hanging": F.col("x_hanging") + F.col("room")})
    middle = F.median(F.when(automatic & numbered, F.col("x_left"))).over(Window.partitionBy("doc_id", "num_id", "level"))
    rows = rows.withColumn("middle", middle).withColumn("x_left", F.when(automatic & numbered & (F.abs(F.col("x_left") - F.col("middle")) <= NEAR), F.col("middle")).otherwise(F.col("x_left")))
    rows = rows.withColumn("x_first_line", F.when(F.col("x_hanging") != 0, none).otherwise(F.col("x_first_line")))
    return rows.select(
        "doc_id", "seq", "mode", (F.greatest("x_left", none) + F.col("x_first_line")).alias("text_start"), F.greatest(F.col("x_left") - F.col("x_hanging"), none).alias("number_start"), *(F.col(f"x_{s}").alias(s) for s in SIDES)
    )
