"""Normalised documents, lines of texts, identity of media, whole pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import assembly, linebreak, media_identity, normalize
from lamina.plans.base import query, table
from lamina.plans.element_queries import para

NONE = "cast(NULL AS string)"


@query("normalised_runs", "SELECT doc_id, seq, (i // 2)::INT AS run, md5(string_agg(w, '' ORDER BY i)) AS v, CASE WHEN any_value(i // 2) % 2 = 0 THEN 'Run1' END AS style FROM (SELECT doc_id, seq, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, seq, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM $PARA)) GROUP BY doc_id, seq, i // 2")
def normalised_runs(spark, d):
    """Every word is a run; two by two they look alike once their colours are in one spelling, and every other pair has a look that becomes a style."""
    lines = para(spark, d).select("doc_id", "seq", F.filter(F.split("text", " "), lambda x: x != "").alias("words"))
    words = lines.select("doc_id", "seq", F.posexplode("words").alias("run", "text"))
    look = "run div 2 % 2 = 0"
    columns = {"bold": f"if({look}, true, if(run % 2 = 0, false, NULL))", "italic": "cast(NULL AS boolean)", "underline": "false", "strike": "cast(NULL AS boolean)", "highlight": "'none'", "color": f"if({look}, if(run % 2 = 0, '#ff0000', 'FF0000'), 'auto')", "font_size": "' '", "font_name": NONE, "field": NONE, "note": NONE}
    runs = words.withColumns({"part": F.lit("document"), "place": F.concat(F.lit("p"), "seq")} | {c: F.expr(x) for c, x in columns.items()})
    lines = lines.filter("size(words) > 0")  # the lines that have runs
    elements = lines.selectExpr("doc_id", "'document' AS part", "seq").distinct().selectExpr("*", "'paragraph' AS kind", f"{NONE} AS style", "cast(map() AS map<string,string>) AS properties")
    styles = lines.select("doc_id").distinct().selectExpr("doc_id", "'Base' AS style_id", "'paragraph' AS type", "'base' AS name", f"{NONE} AS based_on", "map('jc', 'left') AS properties")
    return normalize.normalised(elements, runs, styles)["runs"].select("doc_id", "seq", F.col("run").cast("int").alias("run"), F.md5("text").alias("v"), "style")


def formatted(spark, d):
    """Every line of an order is a paragraph with a style and local formatting, some of which its style says anyway; what makes Head of Base serves where only that is left."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id").withColumn("seq", F.row_number().over(order))
    rows = lines.selectExpr("doc_id", "'document' AS part", "seq", "'paragraph' AS kind", "if(l_returnflag = 'R', 'Head', 'Base') AS style", "map('jc', if(l_linestatus = 'F', 'left', 'right'), 'ind.left', cast(cast(l_quantity % 2 AS int) * 360 AS string), 'numPr.numId', '7') AS properties")
    style = "struct('{0}' AS style_id, 'paragraph' AS type, '{0}' AS name, {1} AS based_on, map('{2}', '{3}') AS properties)"
    styles = rows.select("doc_id").distinct().select("doc_id", F.inline(F.expr(f"array({style.format('Base', NONE, 'jc', 'left')}, {style.format('Head', repr('Base'), 'ind.left', '0')})")))
    runs = rows.selectExpr("doc_id", "part", "seq", "'x' AS place", "0 AS run", "'t' AS text", *(f"cast(NULL AS boolean) AS {c}" for c in normalize.SWITCHES), *(f"{NONE} AS {c}" for c in (*normalize.LOOK, "field", "note")))
    return normalize.normalised(rows, runs, styles)


SIGNED = """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_returnflag = 'R' THEN 'Head' ELSE 'Base' END AS style, CASE WHEN l_linestatus <> 'F' THEN 'right' END AS jc, (l_quantity % 2)::INT * 360 AS ind FROM lineitem),
s AS (SELECT doc_id, seq, CASE WHEN style = 'Base' AND jc IS NULL AND ind = 0 THEN 'Head' ELSE style END AS style, jc, CASE WHEN ind = 0 AND (style = 'Head' OR jc IS NULL) THEN NULL ELSE ind END AS own FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) AS n FROM (SELECT doc_id, style, jc, own, min(seq) AS first_seq FROM s WHERE jc IS NOT NULL OR own IS NOT NULL GROUP BY ALL))"""


@query("normalised_styles", f"{SIGNED} SELECT s.doc_id, s.seq, coalesce('Paragraph' || n, s.style) AS style, '7' AS num_id, NULL AS jc FROM s LEFT JOIN n ON s.doc_id = n.doc_id AND s.style = n.style AND s.jc IS NOT DISTINCT FROM n.jc AND s.own IS NOT DISTINCT FROM n.own")
def normalised_styles(spark, d):
    p = lambda k: F.try_element_at(F.col("properties"), F.lit(k))
    return formatted(spark, d)["elements"].select("doc_id", "seq", "style", p("numPr.numId").alias("num_id"), p("jc").alias("jc"))


@query("normalised_definitions", f"{SIGNED} SELECT doc_id, 'Paragraph' || n AS style_id, style AS based_on, jc, own::VARCHAR AS ind FROM n UNION ALL SELECT DISTINCT doc_id, 'Base', NULL, 'left', NULL FROM l UNION ALL SELECT DISTINCT doc_id, 'Head', 'Base', NULL, '0' FROM l")
def normalised_definitions(spark, d):
    p = lambda k: F.try_element_at(F.col("properties"), F.lit(k))
    return formatted(spark, d)["styles"].select("doc_id", "style_id", "based_on", p("jc").alias("jc"), p("ind.left").alias("ind"))


def lines_duck(cost: str, blank: int, room: str) -> str:
    """Greedy lines by recursion over the words of each turn: a word opens a line where it doesn't fit."""
    return f"""WITH RECURSIVE w AS (SELECT conv_id, turn, i, word, {cost} AS u FROM (SELECT conv_id, turn, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS x FROM conversations WHERE text IS NOT NULL))),
g AS (SELECT conv_id, turn, i, word, u AS used, 0 AS line FROM w WHERE i = 1 UNION ALL SELECT w.conv_id, w.turn, w.i, w.word, CASE WHEN g.used + {blank} + w.u <= {room} THEN g.used + {blank} + w.u ELSE w.u END, CASE WHEN g.used + {blank} + w.u <= {room} THEN g.line ELSE g.line + 1 END FROM g JOIN w ON w.conv_id = g.conv_id AND w.turn = g.turn AND w.i = g.i + 1)"""


@query("broken_lines", lines_duck("600 * length(word) - 322 * (length(word) - length(translate(word, 'il', ''))) + 233 * (length(word) - length(translate(word, 'mw', '')))", 250, "18181")
       + " SELECT conv_id, turn, line, min(i)::INT - 1 AS first, max(i)::INT - 1 AS last, round(max_by(used, i) * 0.011, 6) AS width, md5(string_agg(word, ' ' ORDER BY i)) AS v FROM g GROUP BY conv_id, turn, line UNION ALL SELECT conv_id, turn, 0, 0, -1, 0, md5('') FROM conversations WHERE regexp_matches(text, '^\\s*$')")
def broken_lines(spark, d):
    """Lines of 200 points at size 11 in a font whose narrow and wide letters have widths of their own."""
    font = {"i": 278, "l": 278, "m": 833, "w": 833, " ": 250}
    return linebreak.broken(table(spark, d, "conversations").select("conv_id", "turn", "text"), 200.0, 11.0, font).select("conv_id", "turn", "line", "first", "last", F.round("width", 6).alias("width"), F.md5("text").alias("v"))


@query("broken_lines_by_length", lines_duck("length(word) + 1", 0, "30") + " SELECT conv_id, turn, line, md5(string_agg(word, ' ' ORDER BY i)) AS v FROM g GROUP BY conv_id, turn, line UNION ALL SELECT conv_id, turn, 0, md5('') FROM conversations WHERE regexp_matches(text, '^\\s*$')")
def broken_lines_by_length(spark, d):
    return linebreak.broken_by_length(table(spark, d, "conversations").select("conv_id", "turn", "text"), 200.0, 11.0).select("conv_id", "turn", "line", F.md5("text").alias("v"))


MEDIA_DUCK = """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey % 5 AS k, l_suppkey % 2 AS n FROM lineitem),
o AS (SELECT doc_id, seq, CASE k WHEN 0 THEN 'word/media/' || n || '.png' WHEN 1 THEN 'word/media/' || n || '.png' WHEN 2 THEN 'word/media/' || n || '.png' WHEN 3 THEN 'rel9' || n ELSE 'size' || n END AS one, k < 3 AS file FROM l),
f AS (SELECT doc_id, one, any_value(file) AS file, row_number() OVER (PARTITION BY doc_id ORDER BY min(seq)) - 1 AS id FROM o GROUP BY doc_id, one)"""


def media(spark, d):
    """Every line of an order uses one of two images: by path, by the path of an unpacked copy, by a relationship, by one that leads nowhere, or by its description alone."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    own = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id").withColumn("seq", F.row_number().over(order)).selectExpr("doc_id", "seq", "l_partkey % 5 AS k", "l_suppkey % 2 AS n")
    rows = own.selectExpr("doc_id", "seq", "CASE k WHEN 0 THEN concat('media/', n, '.png') WHEN 1 THEN concat('/tmp/x', seq, '/word/media/', n, '.png') WHEN 2 THEN 'N/A' END AS path", "CASE k WHEN 2 THEN concat('rId', n) WHEN 3 THEN concat('rId9', n) END AS rel_id", "if(k = 2 AND seq % 2 = 0, 'cell', '') AS context", "if(seq % 2 = 0, concat('{\"w\": 1, \"h\": ', n, '}'), concat('{\"h\": ', n, ', \"w\": 1}')) AS info")
    targets = own.select("doc_id").distinct().select("doc_id", F.inline(F.expr("transform(array(0, 1), i -> struct(concat('rId', i) AS rel_id, concat('word/media/', i, '.png') AS path))")))
    return media_identity.registered(rows, targets)


@query("media_references", f"{MEDIA_DUCK} SELECT o.doc_id, o.seq, f.id FROM o JOIN f USING (doc_id, one)")
def media_references(spark, d):
    return media(spark, d)[0]


@query("media_kept", f"{MEDIA_DUCK} SELECT doc_id, id, CASE WHEN file THEN one END AS path FROM f")
def media_kept(spark, d):
    return media(spark, d)[1].select("doc_id", "id", "path")


# Uniform blocks say in closed form where everything lies: ten lines of 10 points a page, less two for a note of 14 and its gap of 6; endnotes of two lines five to a page.
PAGES_DUCK = """WITH b AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS seq FROM lineitem),
p AS (SELECT *, seq // 2 + 1 AS page, seq % 2 AS k FROM b), n AS (SELECT doc_id, max(page) AS body, (count(*) + 4) // 5 AS ends FROM p GROUP BY 1)
SELECT doc_id, page, 'body' AS layer, seq, NULL AS note, (k * 40)::DOUBLE AS y FROM p UNION ALL SELECT doc_id, page, 'footnote', seq, 'n' || seq, 86::DOUBLE FROM p WHERE k = 0
UNION ALL SELECT doc_id, body + 1 + seq // 5, 'endnotes', seq, NULL, (seq % 5 * 20)::DOUBLE FROM b JOIN n USING (doc_id)
UNION ALL SELECT doc_id, q, 'header', -1, CASE WHEN q = 1 THEN 'one' WHEN q % 2 = 0 THEN 'left' ELSE 'all' END, 0 FROM (SELECT doc_id, unnest(range(1, body + ends + 1)) AS q FROM n)
UNION ALL SELECT doc_id, q, 'watermark', -1, 'DRAFT', 0 FROM (SELECT doc_id, unnest(range(1, body + ends + 1)) AS q FROM n) WHERE doc_id % 2 = 0"""


@query("whole_pages", PAGES_DUCK)
def whole_pages(spark, d):
    """Every line of an order is a block of four lines and an endnote of two; every second block has a note on its third line, so two blocks fill a page of 100 points."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(order) - 1).alias("seq"))
    blocks = own.selectExpr("doc_id", "seq", "'paragraph' AS kind", "4 AS lines", "10.0D AS line_h", "0.0D AS before", "0.0D AS after", "false AS break_before", "false AS break_after", "false AS keep", "if(seq % 2 = 0, array(named_struct('line', 2, 'id', concat('n', seq), 'h', 14.0D)), NULL) AS notes")
    docs = own.select("doc_id").distinct()
    headers = docs.select("doc_id", F.inline(F.expr("array(named_struct('variant', 'first', 'text', 'one'), named_struct('variant', 'even', 'text', 'left'), named_struct('variant', 'default', 'text', 'all'))")))
    marks = docs.filter("doc_id % 2 = 0").withColumn("text", F.lit("DRAFT"))
    out = assembly.whole_pages(blocks, headers, marks, own.selectExpr("doc_id", "seq", "2 AS lines", "10.0D AS line_h"), usable=100.0)
    return out.select("doc_id", "page", "layer", "seq", "note", "y")
