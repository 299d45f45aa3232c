"""Tables, layout, templates, numbering and merges over lines of documents, orders and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import checks as C
from lamina.operators import elements as E
from lamina.operators import layout as L
from lamina.operators import merging as M
from lamina.operators import styles as S
from lamina.operators import tables as B
from lamina.operators import templates as P
from lamina.plans.base import blocks, query, sql, table
from lamina.plans.element_queries import KIND, para, rows
from lamina.sinks import text as out

CELLS = "SELECT l_orderkey AS doc_id, l_linenumber AS row, [l_returnflag, CASE WHEN l_quantity > 25 THEN l_linestatus ELSE '' END, CAST(l_partkey AS VARCHAR)] AS cells, l_linenumber = 1 AS is_header, l_quantity > 45 AS merged, l_discount >= 0.09 AS tables, l_tax >= 0.08 AS images FROM lineitem"
BALANCE = "CASE c_custkey % 4 WHEN 0 THEN 'text_heavy' WHEN 1 THEN 'table_heavy' WHEN 2 THEN 'image_heavy' ELSE 'balanced' END"


def cells(spark, d):
    own = F.array("l_returnflag", F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(""), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), own.alias("cells"), (F.col("l_linenumber") == 1).alias("is_header"), "l_quantity", "l_discount", "l_tax")


@query("table_content", f"SELECT doc_id, sum(f)::BIGINT AS filled, sum(3 - f)::BIGINT AS empty, sum(n)::BIGINT AS text_length, arg_min(is_header, row) AS has_header, round(sum(n) / (count(*) * 3), 6) AS mean_length FROM (SELECT *, len(list_filter(cells, lambda c: c <> '')) AS f, length(array_to_string(cells, '')) AS n FROM ({CELLS})) GROUP BY doc_id")
def table_content(spark, d):
    return B.content(cells(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


SCORES = f"SELECT doc_id, bool_or(merged) AS m, bool_or(tables) AS t, bool_or(images) AS i, CASE WHEN bool_or(merged) THEN 2 ELSE 0 END + CASE WHEN bool_or(tables) THEN 3 ELSE 0 END + CASE WHEN bool_or(images) THEN 1 ELSE 0 END AS score FROM ({CELLS}) GROUP BY doc_id"


def scores(spark, d):
    return B.structure(cells(spark, d), F.col("l_quantity") > 45, F.col("l_discount") >= 0.09, F.col("l_tax") >= 0.08)


@query("table_structure", f"SELECT doc_id, m AS merged, t AS nested_tables, i AS nested_images, score, score = 0 AS regular FROM ({SCORES})")
def table_structure(spark, d):
    return scores(spark, d)


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(BALANCE).alias("balance"), (F.col("c_custkey") % 150).alias("total"))


def tables_of_customers(spark, d):
    """The orders of a customer as the tables of a document."""
    owner = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("doc_id"))
    found = scores(spark, d).join(B.content(cells(spark, d)).select("doc_id", "filled", "empty"), "doc_id").join(owner, "doc_id")
    return found.select(F.col("owner").alias("doc_id"), F.col("doc_id").alias("table_id"), "merged", "nested_tables", "filled", "empty", "score")


@query("reading_difficulty", f"SELECT doc_id, points, CASE WHEN points >= 8 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS difficulty FROM (SELECT c_custkey AS doc_id, (CASE c_custkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END + coalesce(sum(CASE WHEN score > 2 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END), 0))::BIGINT AS points FROM customer LEFT JOIN (SELECT o_custkey, s.score FROM orders JOIN ({SCORES}) s ON s.doc_id = o_orderkey) ON o_custkey = c_custkey GROUP BY c_custkey)")
def reading_difficulty(spark, d):
    return B.difficulty(customers(spark, d), tables_of_customers(spark, d))


@query("layout_advice", f"""SELECT c_custkey AS doc_id, md5(CASE WHEN a = '' THEN '|{B.ADVICE_NONE}' ELSE a END) AS v FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '|{"|".join(B.ADVICE_TABLE_HEAVY)}' WHEN 2 THEN '|{"|".join(B.ADVICE_IMAGE_HEAVY)}' ELSE '' END || coalesce(t, '') || CASE WHEN c_custkey % 150 > 100 THEN '|{B.ADVICE_LONG}' ELSE '' END AS a FROM customer LEFT JOIN
  (SELECT o_custkey, string_agg(CASE WHEN m THEN '|{B.ADVICE_MERGED}' ELSE '' END || CASE WHEN t THEN '|{B.ADVICE_NESTED}' ELSE '' END || CASE WHEN e > n - e THEN '|{B.ADVICE_EMPTY}' ELSE '' END, '' ORDER BY o_orderkey) AS t FROM orders JOIN ({SCORES}) s ON s.doc_id = o_orderkey JOIN (SELECT doc_id, sum(len(list_filter(cells, lambda c: c = ''))) AS e, sum(len(cells)) AS n FROM ({CELLS}) GROUP BY doc_id) c ON c.doc_id = o_orderkey GROUP BY o_custkey) ON o_custkey = c_custkey)""")
def layout_advice(spark, d):
    return B.advice(customers(spark, d), tables_of_customers(spark, d)).select("doc_id", F.md5(F.concat(F.lit("|"), F.array_join("advice", "|"))).alias("v"))


FORMS = {"pipe": ("| ", " | ", " |"), "grid": ("+ ", " + ", " +"), "simple": ("", "  ", "")}
LINES = ", ".join(f"md5(string_agg('{a}' || array_to_string(cells, '{b}') || '{c}'" + (" || CASE WHEN p = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END" if k != "simple" else "") + f", chr(10) ORDER BY p) || chr(10)) AS {k}" for k, (a, b, c) in FORMS.items())


@query("markdown_tables", f"SELECT doc_id, {LINES} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row, cells) AS p FROM ({CELLS})) GROUP BY doc_id")
def markdown_tables(spark, d):
    return B.gathered(cells(spark, d)).select("doc_id", *(F.md5(B.markdown(k)).alias(k) for k in FORMS))


@query("flat_tables", f"SELECT doc_id, 3 AS columns, (count(*) * 3)::INT AS total_cells, min(cells[3]) FILTER (p = 2) AS one, md5(string_agg(array_to_string(list_filter(cells, lambda c: c <> ''), chr(9)), chr(10) ORDER BY p)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row, cells) AS p FROM ({CELLS})) GROUP BY doc_id")
def flat_tables(spark, d):
    return B.flat_payload(B.gathered(cells(spark, d))).select("doc_id", "columns", "total_cells", B.cell(1, 2).alias("one"), F.md5(B.table_text()).alias("v"))


def quoted(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"



@query("csv_stream", f"SELECT doc_id, md5(string_agg(CASE WHEN kind = 'paragraph' THEN 'Paragraph,' || {quoted('text')} ELSE array_to_string(list_transform(string_split(text, ' '), lambda x: {quoted('x')}), ',') END || chr(13) || chr(10), '' ORDER BY seq)) AS v FROM (SELECT *, {KIND} AS kind FROM $PARA) WHERE kind = 'table' AND text <> '' OR kind = 'paragraph' AND trim(text) <> '' GROUP BY doc_id")
def csv_stream(spark, d):
    own = rows(spark, d).filter("kind <> 'image' AND text <> ''").withColumn("cells", F.when(F.col("kind") == "table", F.split("text", " ")))
    return out.csv_stream(own).select("doc_id", F.md5("csv").alias("v"))


@query("plain_text", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n(#{{1,6}}\\s)', chr(10) || chr(10) || '\\1', 'g'), '\\n(\\|)', chr(10) || chr(10) || '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)) AS v FROM (SELECT doc_id, 'Text ' || doc_id || chr(10) || repeat('=', length('Text ' || doc_id)) || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY CASE kind WHEN 'paragraph' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, seq) AS t FROM (SELECT *, {KIND} AS kind FROM $PARA) WHERE trim(text) <> '' GROUP BY doc_id)")
def plain_text(spark, d):
    return out.plain(rows(spark, d), F.concat(F.lit("Text "), "doc_id")).select("doc_id", F.md5(F.expr(out.finished("text"))).alias("v"))


sql("markdown_valid", f"SELECT doc_id, seq, {out.markdown_line_valid('text')} AS ok FROM $PARA",
    r"SELECT doc_id, seq, (NOT starts_with(text, '#') OR regexp_matches(text, '^#{1,6}\s')) AND (regexp_matches(text, '^\s*([*+-]|\d+\.)\s') OR NOT contains(text, '|') OR starts_with(ltrim(text), '|')) AS ok FROM $PARA")
sql("page_labels", f"SELECT p_partkey, {L.page_label('p_size', 'f')} AS label FROM (SELECT p_partkey, p_size, element_at(array('roman', 'letters', 'arabic'), cast(p_partkey % 3 + 1 AS int)) AS f FROM part)",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['', 'X', 'XX', 'XXX', 'XL', 'L'][p_size // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] WHEN 1 THEN CASE WHEN p_size <= 26 THEN chr(96 + p_size) ELSE 'a' || chr(70 + p_size) END ELSE p_size::VARCHAR END AS label FROM part")


@query("page_of_position", "SELECT DISTINCT i.l_orderkey AS doc_id, i.l_linenumber AS position, coalesce((SELECT min(b.l_linenumber) // 2 + 1 FROM lineitem b WHERE b.l_orderkey = i.l_orderkey AND b.l_linenumber % 2 = 0 AND b.l_linenumber >= i.l_linenumber), 1)::INT AS page FROM lineitem i")
def page_of_position(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position")).distinct()
    breaks = own.filter("position % 2 = 0").withColumn("page_number", F.expr("position div 2 + 1"))
    return L.page_of(own, breaks)


@query("header_variants", "SELECT l_orderkey, l_linenumber, CASE o_orderstatus WHEN 'F' THEN CASE WHEN l_linenumber = 1 THEN 'cover' ELSE 'plain' END WHEN 'O' THEN CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END ELSE 'plain' END AS header FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def header_variants(spark, d):
    maps = F.when(F.col("o_orderstatus") == "F", F.expr("map('first', 'cover', 'default', 'plain')")).when(F.col("o_orderstatus") == "O", F.expr("map('even', 'left', 'odd', 'right')")).otherwise(F.expr("map('default', 'plain', 'even', '')"))
    own = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), maps.alias("headers")), "l_orderkey")
    return own.select("l_orderkey", "l_linenumber", L.variant("l_linenumber", "headers").alias("header"))


@query("block_spacing", "SELECT doc_id, seq, CASE WHEN p IS NOT NULL AND p <= 0 AND b <= 0 THEN 1 ELSE greatest(coalesce(p, 0), b, 0) END AS gap FROM (SELECT doc_id, seq, b, lag(a) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM (SELECT doc_id, seq, length(text) % 5 - 2 AS b, length(text) % 3 - 1 AS a FROM $PARA))")
def block_spacing(spark, d):
    return L.spaced(para(spark, d).selectExpr("doc_id", "seq", "length(text) % 5 - 2 AS before", "length(text) % 3 - 1 AS after")).select("doc_id", "seq", F.col("gap").cast("long").alias("gap"))


GRID = "array(cast(p_size * 100 AS string), '', cast(p_partkey % 1000 AS string))"
sql("grid_widths", f"SELECT p_partkey, size(w) AS n, round(w[0], 6) AS a, round(w[3], 6) AS d FROM (SELECT p_partkey, {L.grid_widths(GRID, '4')} AS w FROM part)",
    "SELECT p_partkey, 4 AS n, p_size * 100 / 20.0::DOUBLE AS a, round((p_size * 100 / 20.0::DOUBLE + (p_partkey % 1000) / 20.0::DOUBLE) / 2, 6) AS d FROM part")


@query("notes_of_pages", "SELECT doc_id, page, string_agg(note_id, ',' ORDER BY first, note_id) AS notes FROM (SELECT doc_id, seq // 8 AS page, length(text) % 11 AS note_id, min(seq) AS first FROM $PARA GROUP BY ALL) GROUP BY doc_id, page")
def notes_of_pages(spark, d):
    own = para(spark, d).selectExpr("doc_id", "seq", "seq div 8 AS page", "length(text) % 11 AS note_id")
    return L.notes_of_pages(own).select("doc_id", "page", F.array_join("notes", ",").alias("notes"))


@query("paragraph_signatures", "SELECT doc_id, numbered, CASE WHEN NOT numbered THEN indent END AS indent, bold, count(*) AS n, min(seq) AS first_seq FROM (SELECT doc_id, seq, seq % 3 = 0 AS numbered, seq % 4 AS indent, length(text) % 2 = 0 AS bold FROM $PARA) GROUP BY ALL")
def paragraph_signatures(spark, d):
    return L.signatures(para(spark, d).selectExpr("doc_id", "seq", "seq % 3 = 0 AS numbered", "seq % 4 AS indent", "length(text) % 2 = 0 AS bold"), "numbered", "indent", "bold")


PLACED = "SELECT doc_id, seq // 10 + 1 AS page, seq % 10 AS idx, (length(text) % 9 - 1)::DOUBLE AS x, (800 - (seq % 10) * 85)::DOUBLE AS y, (length(text) % 620)::DOUBLE AS w, (length(text) % 50 - 1)::DOUBLE AS h, length(text) % 6 <> 0 AS styled, (seq % 4 - 1)::DOUBLE AS before, (seq % 3 - 1)::DOUBLE AS after FROM $PARA"
CHECKS = [("error", "left_edge", "x < 0"), ("error", "right_edge", "x + w > 595"), ("error", "bottom_edge", "y < 0"), ("error", "top_edge", "y + h > 842"), ("error", "width", "w <= 0"), ("error", "height", "h <= 0"), ("warning", "style", "NOT styled"), ("warning", "before", "before < 0"), ("warning", "after", "after < 0"), ("error", "margin", "y < 72"), ("error", "overlap", "gap < 0"), ("warning", "spacing", "gap >= 0 AND gap < wanted * 0.5")]


@query("layout_issues", f"WITH b AS (SELECT *, y - lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY idx) AS gap, lag(after) OVER (PARTITION BY doc_id, page ORDER BY idx) + before AS wanted FROM ({PLACED})) " + " UNION ALL ".join(f"SELECT doc_id, page, idx, '{level}' AS level, '{rule}' AS rule FROM b WHERE {broken}" for level, rule, broken in CHECKS))
def layout_issues(spark, d):
    n = "cast(length(text)"
    placed = para(spark, d).selectExpr("doc_id", "seq div 10 + 1 AS page", "seq % 10 AS idx", f"{n} % 9 - 1 AS double) AS x", "cast(800 - (seq % 10) * 85 AS double) AS y", f"{n} % 620 AS double) AS w", f"{n} % 50 - 1 AS double) AS h", "length(text) % 6 <> 0 AS styled", "cast(seq % 4 - 1 AS double) AS before", "cast(seq % 3 - 1 AS double) AS after")
    return L.issues(placed, 595.0, 842.0, 72.0)


@query("page_issues", "WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, l_linenumber AS page, min(l_quantity) % 5 AS blocks FROM lineitem GROUP BY 1, 3) SELECT doc_id, page, 'page_number' AS rule FROM p WHERE page <> place UNION ALL SELECT doc_id, page, 'empty_page' FROM p WHERE blocks = 0 AND page > 1")
def page_issues(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg((F.min("l_quantity") % 5).alias("blocks"))
    return L.page_issues(own.withColumn("place", F.row_number().over(L.Window.partitionBy("doc_id").orderBy("page"))))


@query("conditional_hidden", "SELECT doc_id, seq FROM (SELECT doc_id, seq, max(seq) OVER (PARTITION BY doc_id) AS last FROM $PARA) WHERE NOT (seq % 9 BETWEEN 2 AND 5 AND seq - seq % 9 + 5 <= last)")
def conditional_hidden(spark, d):
    return P.conditional(marked(spark, d), "Block", show=False).select("doc_id", "seq")


@query("conditional_shown", "SELECT doc_id, seq, md5(CASE WHEN seq % 9 IN (2, 5) THEN 'a  b' ELSE text END) AS v FROM $PARA")
def conditional_shown(spark, d):
    return P.conditional(marked(spark, d), "Block", show=True).select("doc_id", "seq", F.md5("text").alias("v"))


def marked(spark, d):
    return para(spark, d).withColumn("text", F.expr("CASE seq % 9 WHEN 2 THEN 'a {{START_Block}} b' WHEN 5 THEN 'a { END_Block } b' ELSE text END"))


@query("list_blocks", "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS item, n_name AS item_text, 'decimal' AS format, '%1.' AS template, 1440 AS indent_left, 360 AS indent_hanging FROM $NATION")
def list_blocks(spark, d):
    own = blocks(spark, d).groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return P.list_items(own, "names", "decimal", 1).drop("names", "level")


SIZE = "if(p_partkey % 3 = 0, p_size, NULL)", "if(p_partkey % 5 = 0, p_size * 2, NULL)", "(p_partkey % 1000 + 1)", "(p_size * 10)"
sql("image_sizes", f"SELECT p_partkey, s.w, s.h FROM (SELECT p_partkey, {P.image_size(*SIZE)} AS s FROM part)",
    "SELECT p_partkey, CASE WHEN w IS NOT NULL THEN w WHEN h IS NOT NULL THEN trunc(ow * (h::DOUBLE / oh))::INT ELSE least(ow, 400) END::INT AS w, CASE WHEN h IS NOT NULL THEN h WHEN w IS NOT NULL THEN trunc(oh * (w::DOUBLE / ow))::INT WHEN ow > 400 THEN trunc(oh * (400.0::DOUBLE / ow))::INT ELSE oh END::INT AS h FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS w, CASE WHEN p_partkey % 5 = 0 THEN p_size * 2 END AS h, p_partkey % 1000 + 1 AS ow, p_size * 10 AS oh FROM part)")
sql("qr_texts", f"SELECT p_partkey, {P.qr_text('p_name')} AS v FROM part", "SELECT p_partkey, '[QR: ' || p_name || ']' AS v FROM part")
sql("indents", f"SELECT p_partkey, {P.combined_indent('s', 'l', 'p', 'side')} AS side, {P.first_line('p_size % 2', 'p_size')} AS first FROM (SELECT p_partkey, p_size, named_struct('side', p_size) AS s, if(p_size % 4 = 0, NULL, named_struct('side', p_size * 10)) AS l, named_struct('side', p_size % 3) AS p FROM part)",
    "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 3 WHEN p_size % 4 = 0 THEN p_size ELSE p_size * 10 END AS side, CASE WHEN p_size % 2 = 0 THEN p_size END AS first FROM part")
FIELD = "element_at(array('PAGE \\\\* ROMAN', 'NUMPAGES', 'REF Mark x', 'TOC', 'SEQ a \\\\# 0.0', 'DATE', 'time'), cast(event_id % 7 + 1 AS int))"
sql("field_values", f"SELECT event_id, {P.field_value('f', 'user_id', 'event_id', 'ts')} AS v, {P.field_option('f', '*')} AS n, {P.field_option('f', '#')} AS d FROM (SELECT event_id, user_id, ts, {FIELD} AS f FROM events)",
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '[REF: Mark]' WHEN 3 THEN '[TOC]' WHEN 4 THEN 'SEQ a \\# 0.0' WHEN 5 THEN strftime(ts, '%d.%m.%Y') ELSE strftime(ts, '%H:%M') END AS v, CASE WHEN event_id % 7 = 0 THEN 'ROMAN' END AS n, CASE WHEN event_id % 7 = 4 THEN '0.0' END AS d FROM events")


@query("numbering_levels", "SELECT 1 AS doc_id, n_nationkey AS num_id, level, 'decimal' AS format, '%' || level || '.' AS template, n_regionkey + 1 AS start FROM $NATION, (VALUES (1), (2)) l(level) UNION ALL SELECT 0, n_nationkey AS num_id, level, CASE WHEN n_nationkey % 3 = 1 THEN 'upperRoman' ELSE 'decimal' END AS format, CASE WHEN n_nationkey % 3 = 0 THEN '(%1)' ELSE '%' || level || '.' END AS template, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 THEN 5 ELSE n_regionkey + 1 END AS start FROM $NATION, (VALUES (1), (2)) l(level)")
def numbering_levels(spark, d):
    nations = blocks(spark, d)
    abstract = nations.select("n_regionkey").distinct().selectExpr("n_regionkey AS abstract_id", "explode(array(1, 2)) AS level", "'decimal' AS format", "n_regionkey + 1 AS start").withColumn("template", F.expr("concat('%', level, '.')"))
    over = nations.filter("n_nationkey % 3 < 2").selectExpr("n_nationkey AS num_id", "explode(array(1, 2)) AS level", "if(n_nationkey % 3 = 0, '', 'upperRoman') AS format", "if(n_nationkey % 3 = 0, '(%1)', NULL) AS template", "if(n_nationkey % 3 = 0, 5 * (n_nationkey % 2), NULL) AS start")
    # two documents with the same ids; the second one has no overrides
    two = lambda df: df.crossJoin(spark.range(2).withColumnRenamed("id", "doc_id"))
    return P.levels(two(nations.selectExpr("n_nationkey AS num_id", "n_regionkey AS abstract_id")), two(abstract), over.withColumn("doc_id", F.lit(0).cast("long")))


@query("rewound_counters", "SELECT user_id, list_reduce(list_prepend(0, list(CASE WHEN event_type IN ('error', 'click') THEN -1 ELSE 1 END ORDER BY event_id)), lambda a, x: greatest(a + x, 0))::BIGINT AS last FROM events GROUP BY user_id")
def rewound_counters(spark, d):
    step = F.when(F.col("event_type").isin("error", "click"), -1).otherwise(1)
    return P.rewound_counters(table(spark, d, "events"), "user_id", "event_id", step).groupBy("user_id").agg(F.max_by("counter", "event_id").alias("last"))


@query("merge_many", f"WITH r AS (SELECT doc_id // 4 AS g, doc_id, seq, {KIND} AS kind, text FROM $PARA), a AS (SELECT * FROM r UNION ALL SELECT g, doc_id, -1, 'page_break', '' FROM (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS n FROM r GROUP BY g, doc_id) WHERE n > 1) SELECT g, doc_id, kind, md5(text) AS v, row_number() OVER (PARTITION BY g ORDER BY doc_id, seq) - 1 AS seq FROM a")
def merge_many(spark, d):
    return M.merged_in_order(rows(spark, d).withColumn("g", F.expr("doc_id div 4")), "g").select("g", "doc_id", "kind", F.md5("text").alias("v"), F.col("seq").cast("long").alias("seq"))


def brands(spark, d, condition):
    return table(spark, d, "part").filter(condition).groupBy(F.col("p_type").alias("style_id")).agg(F.max("p_size").alias("size")).withColumn("doc_id", F.lit(1))


@query("style_union", "WITH t AS (SELECT p_type AS s, max(p_size) AS size FROM part WHERE p_size < 20 AND p_partkey % 2 = 0 GROUP BY 1), u AS (SELECT p_type AS s, max(p_size) AS size FROM part WHERE p_size >= 20 GROUP BY 1) SELECT s AS style_id, s AS old_id, size FROM t UNION ALL SELECT CASE WHEN s IN (SELECT s FROM t) THEN s || '_merged' ELSE s END, s, size FROM u")
def style_union(spark, d):
    return M.styles_merged(brands(spark, d, "p_size < 20 AND p_partkey % 2 = 0"), brands(spark, d, "p_size >= 20")).select("style_id", "old_id", "size")


@query("unused_styles", "SELECT DISTINCT p_type AS style_id FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 3) AND p_type <> 'PROMO'")
def unused_styles(spark, d):
    return M.unused(brands(spark, d, "true"), brands(spark, d, "p_size < 3"), ("PROMO",)).select("style_id")


@query("header_replacement", "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN 'new ' || n_name ELSE n_name END AS n_name FROM $NATION")
def header_replacement(spark, d):
    own = blocks(spark, d).select("n_nationkey", "n_name")
    return M.replaced(own.filter("n_nationkey < 20"), own.filter("n_nationkey >= 10").withColumn("n_name", F.concat(F.lit("new "), "n_name")), "n_nationkey", "n_name")


@query("relationship_ids", "SELECT n_nationkey, 'rId' || (CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey * 10 ELSE 0 END + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)) AS new_id FROM $NATION")
def relationship_ids(spark, d):
    own = blocks(spark, d).withColumn("above", F.expr("if(n_regionkey % 2 = 0, n_regionkey * 10, NULL)"))
    return M.new_ids(own, "n_regionkey", "n_name", "above").select("n_nationkey", "new_id")


@query("copied_references", "SELECT s_suppkey % 3 AS doc_id, s_suppkey, CASE WHEN s_suppkey % 3 < 2 AND s_nationkey % 2 = 0 THEN s_nationkey + 100 * (s_suppkey % 3 + 1) ELSE s_nationkey END AS s_nationkey FROM supplier")
def copied_references(spark, d):
    """Two of three documents have new ids of their own for the same old ones."""
    mapping = table(spark, d, "nation").filter("n_nationkey % 2 = 0").selectExpr("explode(array(0L, 1L)) AS doc_id", "n_nationkey AS old").selectExpr("doc_id", "old", "old + 100 * (doc_id + 1) AS new")
    return M.remapped(table(spark, d, "supplier").selectExpr("s_suppkey % 3 AS doc_id", "s_suppkey", "s_nationkey"), "s_nationkey", mapping, "old", "new")


CYCLE = "CASE WHEN n_nationkey < 4 THEN (n_nationkey + 1) % 4 WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_nationkey // 2 ELSE n_nationkey - 4 END"


@query("style_cycles", f"WITH RECURSIVE st AS (SELECT n_nationkey AS id, {CYCLE} AS base FROM nation), up AS (SELECT id, base, [id] AS path FROM st UNION ALL SELECT up.id, st.base, list_append(path, st.id) FROM up JOIN st ON st.id = up.base WHERE NOT list_contains(path, st.id)) SELECT id::VARCHAR AS style_id, max(len(path) - 1)::INT AS depth, bool_or(coalesce(list_contains(path, base), false)) AS cyclic FROM up GROUP BY id")
def style_cycles(spark, d):
    own = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("style_id"), F.expr(CYCLE.replace("//", "div")).cast("string").alias("based_on"))
    return M.cycles(own.withColumn("doc_id", F.lit(1))).drop("doc_id")


@query("style_clean", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'bold,' ELSE '' END || 'brand' || CASE WHEN p_size % 2 = 0 THEN ',size' ELSE '' END AS kept FROM part")
def style_clean(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.expr("map('size', if(p_size % 2 = 0, cast(p_size AS string), ''), 'brand', p_brand, 'bold', if(p_size % 3 = 0, 'false', 'true'), 'none', cast(NULL AS string))").alias("style"))
    return own.select("p_partkey", F.array_join(F.array_sort(F.map_keys(S.pruned("style"))), ",").alias("kept"))


@query("link_islands", "SELECT user_id, min(event_id) AS first_id, count(*) AS n, event_type FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g, event_type")
def link_islands(spark, d):
    own = table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS seq", "event_type", "props AS text")
    return E.islands(own, "event_type").select(F.col("doc_id").alias("user_id"), F.col("first_seq").alias("first_id"), "n", "event_type")


@query("block_gaps", f"SELECT doc_id, seq, round(y - lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY seq), 6) AS gap FROM (SELECT doc_id, seq // 10 AS page, seq, (seq * 7 % 40)::DOUBLE AS y, (length(text) % 13)::DOUBLE AS h FROM $PARA)")
def block_gaps(spark, d):
    return E.gaps(para(spark, d).selectExpr("doc_id", "seq", "seq div 10 AS page", "cast(seq * 7 % 40 AS double) AS y", "cast(length(text) % 13 AS double) AS h")).select("doc_id", "seq", F.round("gap", 6).alias("gap"))


@query("layout_summary", f"WITH b AS (SELECT *, y - lag(y + h) OVER (PARTITION BY doc_id, page ORDER BY idx) AS gap, lag(after) OVER (PARTITION BY doc_id, page ORDER BY idx) + before AS wanted FROM ({PLACED})) SELECT doc_id, sum(e) = 0 AS valid, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, count(DISTINCT page) AS pages, count(*) AS blocks FROM (SELECT doc_id, page, " + " + ".join(f"coalesce(({broken})::INT, 0)" for level, _, broken in CHECKS if level == "error") + " AS e, " + " + ".join(f"coalesce(({broken})::INT, 0)" for level, _, broken in CHECKS if level == "warning") + " AS w FROM b) GROUP BY doc_id")
def layout_summary(spark, d):
    return C.summary(para(spark, d).selectExpr("doc_id", "seq div 10 + 1 AS page"), layout_issues(spark, d))


sql("paragraph_breaks", f"SELECT p_partkey, {L.paragraph_break('p_size', '(p_partkey % 3)', '12D', '(p_partkey % 300)', '4D', '2D', '(p_partkey % 5 = 0)')} AS line FROM part",
    "SELECT p_partkey, CASE WHEN n <= 0 OR n * 12 + 2 + t <= a THEN p_size WHEN p_partkey % 5 = 0 AND s = 0 THEN NULL WHEN h < 2 THEN s ELSE s + h END::BIGINT AS line FROM (SELECT *, CASE WHEN n - m < 2 THEN m - 1 ELSE m END AS h FROM (SELECT *, least(greatest(floor((a - t) / 12), 0), n - 1) AS m FROM (SELECT p_partkey, p_size, p_partkey % 3 AS s, p_partkey % 300 + 1e-6 AS a, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END AS t, p_size - p_partkey % 3 AS n FROM part)))")


def header_items(spark, d):
    return blocks(spark, d).selectExpr("n_regionkey AS doc_id", "'default' AS variant", "n_nationkey AS seq", "cast(n_nationkey % 3 AS double) AS before", "cast(n_nationkey % 20 AS double) AS h", "2D AS after")


USED = "n_nationkey % 3 + CASE WHEN n_nationkey % 20 > 0 THEN n_nationkey % 20 ELSE 20 END"


@query("header_places", f"SELECT n_regionkey AS doc_id, n_nationkey AS seq, (842 - 36 + 2 - sum({USED} + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::DOUBLE AS y FROM $NATION")
def header_places(spark, d):
    return L.header_places(header_items(spark, d), 842.0, 36.0).select("doc_id", "seq", "y")


@query("body_offsets", f"SELECT n_regionkey AS doc_id, 'default' AS variant, greatest(90, 36 + sum({USED} + 2))::DOUBLE AS \"offset\" FROM $NATION GROUP BY 1")
def body_offsets(spark, d):
    return L.body_offsets(header_items(spark, d), 36.0, 90.0)


@query("run_safe_replace", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Dear ' || p_brand || ' of |||' || p_name WHEN 1 THEN 'a ' || p_brand || ' {TEXT:Name}|' || p_name ELSE p_name END AS v FROM part")
def run_safe_replace(spark, d):
    own = table(spark, d, "part").withColumn("runs", F.expr("CASE p_partkey % 3 WHEN 0 THEN array('Dear {TE', 'XT:Na', 'me} of ', p_name) WHEN 1 THEN array('a {TEXT:Name} {TEXT:Name}', p_name) ELSE array(p_name) END"))
    return P.replaced_in_runs(own, "runs", "{TEXT:Name}", F.col("p_brand")).select("p_partkey", F.array_join("runs", "|").alias("v"))


@query("flat_json", f"SELECT doc_id, count(*) AS elements, count(nullif(text, '')) AS texts, md5(string_agg(kind || '_' || seq || text, '|' ORDER BY seq)) AS v FROM (SELECT *, {KIND} AS kind FROM $PARA) GROUP BY doc_id")
def flat_json(spark, d):
    read = out.flat_json(rows(spark, d)).select("doc_id", F.from_json("json", "elements array<struct<id:string,text:string>>")["elements"].alias("e"))
    texts = F.transform("e", lambda x: F.concat(x["id"], F.coalesce(x["text"], F.lit(""))))
    return read.select("doc_id", F.size("e").cast("long").alias("elements"), F.size(F.filter("e", lambda x: x["text"].isNotNull())).cast("long").alias("texts"), F.md5(F.array_join(texts, "|")).alias("v"))


@query("html_paragraphs", "SELECT doc_id, md5(string_agg('<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</p>', chr(10) ORDER BY seq)) AS v FROM $PARA GROUP BY doc_id")
def html_paragraphs(spark, d):
    return out.html(para(spark, d)).select("doc_id", F.md5("html").alias("v"))


@query("round_trip_compare", "SELECT doc_id, count_if(seq % 6 = 5)::BIGINT AS lost, sum(CASE WHEN seq % 6 = 5 THEN length(text) ELSE 0 END)::BIGINT AS text_lost, CASE WHEN sum(length(text)) > 0 THEN round(sum(CASE WHEN seq % 6 = 5 THEN length(text) ELSE 0 END) / sum(length(text)) * 100, 2) ELSE 0 END AS lost_percent, count_if(seq < 20 AND seq % 6 <> 5)::BIGINT AS equal_places FROM $PARA GROUP BY doc_id")
def round_trip_compare(spark, d):
    return C.compared(para(spark, d), para(spark, d).filter("seq % 6 <> 5"))


@query("document_issues", """
  SELECT o_orderkey AS doc_id, 'warning' AS level, 'no_text' AS rule, 'document' AS kind, o_orderkey::VARCHAR AS element FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT l_orderkey, 'warning', 'no_rows', 'table', l_partkey::VARCHAR FROM lineitem WHERE l_linenumber % 4 = 0 UNION ALL SELECT l_orderkey, 'warning', 'empty_table', 'table', l_partkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT o_orderkey, 'warning', 'no_styles', 'styles', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3)
  UNION ALL SELECT o_orderkey, 'warning', 'no_sections', 'sections', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT l_orderkey, 'warning', 'no_name', 'style', l_linenumber::VARCHAR FROM lineitem WHERE l_linenumber < 3 AND l_linestatus = 'O' UNION ALL SELECT l_orderkey, 'warning', 'no_type', 'style', l_linenumber::VARCHAR FROM lineitem WHERE l_linenumber < 3 AND l_returnflag = 'N'
  UNION ALL SELECT a.l_orderkey, 'warning', 'missing_base', 'style', a.l_linenumber::VARCHAR FROM lineitem a WHERE a.l_linenumber < 3 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = 3 - a.l_linenumber)
  UNION ALL SELECT l_orderkey, 'warning', 'missing_abstract', 'numbering', l_linenumber::VARCHAR FROM lineitem WHERE l_suppkey % 9 NOT IN (0, 4)
  UNION ALL SELECT o_orderkey, 'warning', 'no_margins', 'section', '0' FROM orders WHERE o_orderkey % 7 = 1""")
def document_issues(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    documents = orders.selectExpr("o_orderkey AS doc_id", "if(o_orderstatus = 'P', ' ', o_orderstatus) AS text")
    styles = lines.filter("l_linenumber < 3").selectExpr("doc_id", "cast(l_linenumber AS string) AS style_id", "if(l_linestatus = 'O', NULL, 'n') AS name", "if(l_returnflag = 'N', '', 'paragraph') AS type", "cast(3 - l_linenumber AS string) AS based_on")
    abstract = orders.selectExpr("o_orderkey AS doc_id", "explode(array('0', '4')) AS abstract_id")
    return C.document_issues(
        documents, lines.selectExpr("doc_id", "l_partkey AS table_id", "l_linenumber % 4 AS n_rows", "nullif(l_returnflag, 'R') AS text"), styles,
        lines.selectExpr("doc_id", "l_linenumber AS num_id", "cast(l_suppkey % 9 AS string) AS abstract_id"), abstract,
        orders.filter("o_orderkey % 7 > 0").selectExpr("o_orderkey AS doc_id", "0 AS section", "o_orderkey % 7 <> 1 AS margins"),
    )
