"""Templates filled as a whole: texts to a fixpoint, conditional sections, then blocks (tables, lists, images, watermarks) in place of their placeholders.

A document's values are formatted once, into a map from names to texts. A paragraph is split at its placeholders once a pass and put together again by look-ups in that map,
so neither the plan nor the work grows with the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina import scratch
from lamina.functions import text as T
from lamina.operators import templates

PASSES = 5
#: `{{ NAME }}` and `{ NAME }` with at most one blank on each side.
TOKEN = r"\\{\\{ ?[^{}]*[^{} ] ?\\}\\}|\\{ ?[^{}]*[^{} ] ?\\}"
NAME = r"regexp_replace({}, '^\\{{\\{{? ?| ?\\}}\\}}?$', '')"
BLOCKS = ("TABLE", "LIST", "IMAGE", "WATERMARK")
#: What a block puts in place of its placeholder, a row each.
INSERT = "struct<kind: string, text: string, cells: array<string>, bold: boolean, style: string, format: string, path: string, width: int, height: int>"


def kind_of(key: str) -> str:
    """The type that a key's prefix names, in capitals; empty without one."""
    return key.partition(":")[0].upper() if ":" in key else ""


def shown(key: str, value: str) -> str:
    """SQL expression: a value as its placeholder shows it; null stays null. Notes, formulas and QR codes are texts; other types as in ``templates.typed``."""
    kind, text = kind_of(key), f"cast({value} AS string)"
    marked = {"QR": templates.qr_text(text), "FOOTNOTE": f"concat('* ', {text})", "ENDNOTE": f"concat('[', {text}, ']')", "FORMULA": T.formula(text)}
    return f"if({value} IS NULL, NULL, {marked.get(kind) or templates.typed(key, value)})"


def names_of(key: str) -> list[str]:
    """A key fills its own name and, behind a prefix, the bare one."""
    return [key, key.partition(":")[2]] if ":" in key else [key]


def text_map(values: dict[str, str], null: str = "NULL") -> Column:
    """name -> text of a row's values (key -> SQL expression). A bare name that is also a key of its own is that key's. ``null``: what stands for a null value; names
    whose text is null are left out."""
    by_name = {name: (key, value) for key, value in values.items() for name in names_of(key)} | {key: (key, value) for key, value in values.items()}
    pairs = ", ".join(f"struct({_text(name)} AS name, coalesce({shown(key, value)}, {null}) AS text)" for name, (key, value) in by_name.items())
    return F.expr(f"map_from_entries(filter(array({pairs}), x -> x.text IS NOT NULL))") if pairs else F.create_map().cast("map<string,string>")


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def substituted(text: str, values: str) -> str:
    """SQL expression: one pass over ``text``: each placeholder that the map ``values`` knows gives way to its text."""
    found = f"transform(regexp_extract_all({text}, '{TOKEN}', 0), t -> coalesce(try_element_at({values}, {NAME.format('t')}), t))"
    return f"array_join(zip_with(split({text}, '{TOKEN}', -1), {found}, (p, v) -> concat(p, coalesce(v, ''))), '')"


def fixpoint(text: str, values: str) -> str:
    """SQL expression: passes until nothing changes, PASSES at most: a text that is put in may hold placeholders. Texts without a brace are left alone."""
    step = f"if(a.open, transform(array({substituted('a.text', values)}), t -> named_struct('text', t, 'open', t <> a.text))[0], a)"
    return f"if(contains({text}, '{{'), aggregate(sequence(1, {PASSES}), named_struct('text', {text}, 'open', true), (a, i) -> {step}).text, {text})"


def texts(rows: DataFrame, values: dict[str, str], column: str = "text") -> DataFrame:
    """``column`` with every placeholder replaced by its typed value (key -> SQL expression over the row) to a fixpoint; a null value is the empty text."""
    return rows.withColumn("_values", text_map(values, "''")).withColumn(column, F.expr(fixpoint(column, "_values"))).drop("_values")


def table_block(cells: str, style: str = "TableGrid") -> str:
    """SQL expression: an array of rows of cells as a block; the first row is the header, and without one beneath it there is no block."""
    row = f"named_struct('kind', 'table_row', 'text', '', 'cells', r, 'bold', i = 0, 'style', '{style}', 'format', '', 'path', '', 'width', 0, 'height', 0)"
    return f"if(size({cells}) > 1, transform({cells}, (r, i) -> {row}), NULL)"


def list_block(items: str, style: str = "bullet") -> str:
    """SQL expression: an array of texts as list items."""
    form = "bullet" if style == "bullet" else "decimal"
    row = f"named_struct('kind', 'list_item', 'text', x, 'cells', cast(NULL AS array<string>), 'bold', false, 'style', '', 'format', '{form}', 'path', '', 'width', 0, 'height', 0)"
    return f"if(size({items}) > 0, transform({items}, x -> {row}), NULL)"


def image_block(path: str, width: str = "NULL", height: str = "NULL", own_width: str = "400", own_height: str = "300") -> str:
    """SQL expression: an image; a side that isn't given follows the other one."""
    size = templates.image_size(f"cast({width} AS int)", f"cast({height} AS int)", own_width, own_height)
    row = "named_struct('kind', 'image', 'text', '', 'cells', cast(NULL AS array<string>), 'bold', false, 'style', '', 'format', '', 'path', p, 'width', z.w, 'height', z.h)"
    return f"if({path} IS NULL, NULL, transform(array({size}), z -> transform(array({path}), p -> {row})[0]))"


def watermark_block(text: str) -> str:
    """SQL expression: a watermark, a row without a place in the flow."""
    row = "named_struct('kind', 'watermark', 'text', w, 'cells', cast(NULL AS array<string>), 'bold', false, 'style', '', 'format', '', 'path', '', 'width', 0, 'height', 0)"
    return f"if({text} IS NULL, NULL, transform(array({text}), w -> {row}))"


def block_map(blocks: dict[str, str]) -> Column:
    """name -> rows of a row's blocks (key -> SQL expression that gives a block)."""
    pairs = ", ".join(f"struct({_text(key)} AS name, cast({value} AS array<{INSERT}>) AS rows)" for key, value in blocks.items())
    return F.expr(f"map_from_entries(filter(array({pairs}), x -> x.rows IS NOT NULL))") if pairs else F.create_map().cast(f"map<string,array<{INSERT}>>")


def conditional(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Sections of all names at once. ``_shown`` (map name -> boolean) says which show: their markers go; the rows of the others go from START to END.

    A section runs from a START while it is closed to the next END; a hidden one without an end stays, and names that the map lacks are left alone.
    """
    tokens = f"transform(regexp_extract_all(text, '{TOKEN}', 0), t -> {NAME.format('t')})"
    marks = rows.filter(F.contains("text", F.lit("START_")) | F.contains("text", F.lit("END_"))).select(*keys, order, "_shown", F.explode(F.expr(tokens)).alias("_t"))
    marks = marks.select(*keys, order, F.regexp_extract("_t", "^(START|END)_(.*)$", 1).alias("_side"), F.regexp_extract("_t", "^(START|END)_(.*)$", 2).alias("_name"), "_shown").filter("_side <> '' AND try_element_at(_shown, _name) = false")
    by_name = Window.partitionBy(*keys, "_name").orderBy(order, F.desc("_side"))
    opened = F.coalesce(F.last("_side").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit("END")) == "START"
    turns = marks.withColumn("_opened", opened).filter((F.col("_side") == "START") != F.col("_opened"))  # a START while open and an END while closed change nothing
    found = turns.withColumn("_end", F.lead(order).over(by_name)).filter("_side = 'START' AND _end IS NOT NULL")
    steps = found.select(*keys, F.col(order).cast("long").alias("_at"), F.lit(1).alias("_step")).unionByName(found.select(*keys, (F.col("_end") + 1).cast("long").alias("_at"), F.lit(-1).alias("_step")))
    steps = steps.groupBy(*keys, "_at").agg(F.sum("_step").alias("_step"))
    # every row and every step in one order; hidden are the rows where more sections have begun than ended
    both = rows.withColumn("_at", F.col(order).cast("long")).unionByName(steps, allowMissingColumns=True)
    depth = F.sum(F.coalesce("_step", F.lit(0))).over(Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    left = both.withColumn("_depth", depth).filter(F.col(order).isNotNull() & (F.col("_depth") <= 0)).drop("_at", "_step", "_depth")
    markers = F.expr("map_from_entries(flatten(transform(map_keys(map_filter(_shown, (k, v) -> v)), k -> array(struct(concat('START_', k) AS name, '' AS text), struct(concat('END_', k) AS name, '' AS text)))))")
    return left.withColumn("_markers", markers).withColumn("text", F.expr(f"if(contains(text, 'START_') OR contains(text, 'END_'), {substituted('text', '_markers')}, text)")).drop("_markers")


def filled(rows: DataFrame, data: DataFrame, values: dict[str, str], blocks: dict[str, str] | None = None, sections: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """The rows (key, seq, kind, text, ...) with everything filled: their own columns, and with ``blocks`` cells, bold, style, format, path, width, height and a new seq.

    ``data`` has one row a document; ``values``, ``blocks`` and ``sections`` (name -> whether it shows) are SQL expressions over it. Texts come first, so that they may bring markers and blocks;
    then sections; then blocks, whose own texts are filled as well. A paragraph with nothing but placeholders of tables, lists or watermarks gives way to them; any other keeps its
    text without them and they follow. What has no value keeps its placeholder, as do documents without a row of data. Parts of a document (column ``part``) are filled each for itself.
    """
    blocks, sections = blocks or {}, sections or {}
    keys = [key, *(c for c in ("part",) if c in rows.columns)]
    shows = F.expr(f"map_from_entries(filter(array({', '.join(f'struct({_text(n)} AS name, cast({v} AS boolean) AS shows)' for n, v in sections.items())}), x -> x.shows IS NOT NULL))") if sections else F.create_map().cast("map<string,boolean>")
    own = data.select(key, text_map(values).alias("_values"), block_map(blocks).alias("_blocks"), shows.alias("_shown"))
    none = F.create_map()
    empty = {"_values": "map<string,string>", "_blocks": f"map<string,array<{INSERT}>>", "_shown": "map<string,boolean>"}
    with_own = lambda rows, *names: rows.join(own.select(key, *names).hint("merge"), key, "left").withColumns({n: F.coalesce(n, none.cast(empty[n])) for n in names})
    met = with_own(rows, *(("_values",) if sections or not blocks else ("_values", "_blocks"))).withColumn("text", F.expr(fixpoint("text", "_values")))
    if sections:  # markers, their filter and the rows would each fill the texts anew
        met = conditional(with_own(scratch.written(met.select(*rows.columns), "filled"), "_shown"), keys).select(*rows.columns)
        met = with_own(met, "_values", "_blocks") if blocks else met
    if not blocks:
        return met.select(*rows.columns)
    tokens = f"filter(transform(regexp_extract_all(text, '{TOKEN}', 0), t -> {NAME.format('t')}), n -> map_contains_key(_blocks, n))"
    met = met.withColumn("_met", F.expr(f"if(contains(text, '{{'), {tokens}, cast(array() AS array<string>))"))
    gone = "transform_values(map_filter(_blocks, (k, v) -> array_contains(_met, k)), (k, v) -> '')"
    met = met.withColumn("text", F.expr(f"if(size(_met) = 0, text, {substituted('text', gone)})"))
    vanishes = F.expr("size(_met) > 0 AND trim(text) = '' AND forall(_met, n -> forall(_blocks[n], x -> x.kind <> 'image'))")
    inserts = F.expr("flatten(transform(_met, n -> _blocks[n]))")
    plain = F.when(vanishes, F.array().cast(f"array<{INSERT}>")).otherwise(F.array(F.lit(None).cast(INSERT)))
    flat = met.select(*rows.columns, "_values", F.posexplode(F.concat(plain, inserts)).alias("_part", "_x"))
    added = ("cells", "bold", "style", "format", "path", "width", "height")
    mine = lambda c: F.col(c) if c in (*keys, "seq") else F.coalesce(f"_x.{c}", c) if c in (*added, "kind", "text") else F.when(F.col("_x").isNull(), F.col(c))
    out = flat.select(*(mine(c).alias(c) for c in rows.columns), *(F.col(f"_x.{c}").alias(c) for c in added if c not in rows.columns), "_values", "_part")
    inner = F.col("kind").isin("table_row", "list_item", "watermark")
    out = out.withColumn("text", F.when(inner, F.expr(fixpoint("text", "_values"))).otherwise(F.col("text"))).withColumn("cells", F.expr(f"transform(cells, c -> {fixpoint('c', '_values')})"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("seq", "_part")) - 1  # cells of a table share their place
    return out.withColumn("seq", number).drop("_part", "_values")
