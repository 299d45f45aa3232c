"""Writers and readers in round trips, assembled pages and indents over lines of documents and conversations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lamina.operators import assembly as A
from lamina.operators import lists as I
from lamina.operators import tables as B
from lamina.plans.base import query, sql, table
from lamina.plans.element_queries import para, rows
from lamina.sinks import pdf, workbook
from lamina.sinks import text as out
from lamina.sources import layout_json as J


TEXTS = ArrayType(ArrayType(StringType()))


@F.pandas_udf(TEXTS)
def sheet_rows(content: pd.Series) -> pd.Series:
    return content.map(workbook.sheet_rows)


@query("pdf_round_trip", "SELECT doc_id, ceil(count(*) / 50)::INT AS pages, count(*)::INT AS lines, md5(string_agg(text, chr(10) ORDER BY seq)) AS v FROM $PARA GROUP BY doc_id")
def pdf_round_trip(spark, d):
    found = pdf.read_texts(pdf.write_pdfs(pdf.set_lines(para(spark, d)), "doc_id"), "doc_id").withColumnRenamed("pages", "p")
    return found.select("doc_id", F.size("p").alias("pages"), F.size(F.flatten("p")).alias("lines"), F.md5(F.array_join(F.flatten("p"), "\n")).alias("v"))


def turns(spark, d):
    """Turns as elements: the assistant's are tables of a header row and one more, the others paragraphs."""
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seq"), F.when(F.col("role") == "assistant", "table").otherwise("paragraph").alias("kind"), "role", "text")
    line = lambda i, cells, header: F.struct(F.lit(i).alias("row_idx"), cells.alias("cells"), F.lit(header).alias("is_header"))
    table_rows = F.array(line(0, F.array("role", F.lit("n")), True), line(1, F.array("text", F.length("text").cast("string")), False))
    single = F.array(line(0, F.array().cast("array<string>"), False))
    return own.select("doc_id", "seq", "kind", "text", F.inline(F.when(F.col("kind") == "table", table_rows).otherwise(single)))


@query("workbook_round_trip", """
  WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) AS k FROM conversations WHERE role = 'assistant' OR trim(text) <> ''),
  l AS (SELECT conv_id, turn, 0 AS r, CASE WHEN role = 'assistant' THEN 'Table ' || k ELSE 'Paragraph|' || text END AS line FROM t
    UNION ALL SELECT conv_id, turn, 1, role || '|n' FROM t WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 2, text || '|' || length(text) FROM t WHERE role = 'assistant')
  SELECT conv_id AS doc_id, count(*)::INT AS n, md5(string_agg(line, '||' ORDER BY turn, r)) AS v FROM l GROUP BY conv_id""")
def workbook_round_trip(spark, d):
    found = workbook.write_workbooks(workbook.row_plan(turns(spark, d))).select("doc_id", sheet_rows("content").alias("r"))
    return found.select("doc_id", F.size("r").alias("n"), F.md5(F.array_join(F.transform("r", lambda x: F.array_join(x, "|")), "||")).alias("v"))


@query("nested_json", "SELECT conv_id AS doc_id, count(*)::INT AS elements, (count_if(role = 'assistant') * 4)::INT AS cells, md5(string_agg(CASE WHEN role = 'assistant' THEN role || '|n|' || text || '|' || length(text) ELSE 'paragraph_' || turn END, '||' ORDER BY turn)) AS v FROM conversations GROUP BY conv_id")
def nested_json(spark, d):
    own = turns(spark, d)
    cells = own.filter("kind = 'table'").select("doc_id", "seq", "row_idx", F.posexplode("cells").alias("col_idx", "text"))
    elements = own.filter("row_idx = 0").select("doc_id", "seq", "kind", "text")
    schema = "document struct<body:struct<elements:array<struct<id:string,table:struct<rows:array<struct<cells:array<struct<text:string>>>>>>>>>"
    read = out.nested_json(elements, cells).select("doc_id", F.from_json("json", schema)["document"]["body"]["elements"].alias("e"))
    texts = F.transform("e", lambda x: F.coalesce(F.array_join(F.flatten(F.transform(x["table"]["rows"], lambda r: r["cells"]["text"])), "|"), x["id"]))
    counts = F.aggregate("e", F.lit(0), lambda a, x: a + F.when(x["table"].isNotNull(), F.size(F.flatten(x["table"]["rows"]["cells"]))).otherwise(0))
    return read.select("doc_id", F.size("e").alias("elements"), counts.alias("cells"), F.md5(F.array_join(texts, "||")).alias("v"))


def placed(spark, d):
    part = F.when(F.col("seq") % 20 == 0, "header").when(F.col("seq") % 20 == 19, "footer").otherwise("body")
    return para(spark, d).select("doc_id", "seq", (F.floor(F.col("seq") / 20) + 1).cast("int").alias("page"), part.alias("part"), F.lit("paragraph").alias("kind"), F.lit(72.0).alias("x"), (F.col("seq") % 20 * 30.0).alias("y"), F.lit(451.0).alias("w"), F.lit(14.0).alias("h"), F.concat(F.lit('{"level":'), (F.length("text") % 3).cast("string"), F.lit("}")).alias("style"), "text")


@query("layout_json_pages", """
  SELECT doc_id, seq // 20 + 1 AS page, CASE seq % 20 WHEN 0 THEN 'header' WHEN 19 THEN 'footer' ELSE 'body' END AS part, CASE WHEN seq % 20 IN (0, 19) THEN 0 ELSE seq % 20 - 1 END AS idx,
    (seq % 20 * 30)::DOUBLE AS y, '{"level":' || length(text) % 3 || '}' AS style, 'b-' || seq AS uid, md5(text) AS v FROM $PARA""")
def layout_json_pages(spark, d):
    return J.scan(J.written(placed(spark, d))).select("doc_id", "page", "part", "idx", "y", "style", "uid", F.md5("text").alias("v"))


@query("layout_json_media", """
  SELECT doc_id, seq, CASE WHEN seq % 4 = 1 THEN '{"path":"word/media/' || length(text) % 3 || '.png"}' END AS media FROM $PARA""")
def layout_json_media(spark, d):
    """Every fourth block shows one of three images; the dictionary holds each once."""
    media = F.when(F.col("seq") % 4 == 1, F.concat(F.lit('{"path":"word/media/'), (F.length("text") % 3).cast("string"), F.lit('.png"}')))
    return J.scan(J.written(placed(spark, d).withColumn("media", media))).select("doc_id", "seq", "media")


@query("layout_json_model", """WITH p AS (SELECT *, seq % 3 AS k FROM $PARA)
  SELECT doc_id, 'body' AS part, NULL AS rel, seq, CASE k WHEN 0 THEN 'paragraph' WHEN 1 THEN 'cell' ELSE 'image' END AS kind, CASE WHEN k = 1 THEN c // 2 END AS row_idx, CASE WHEN k = 1 THEN c % 2 END AS col_idx, CASE k WHEN 0 THEN md5(text || '!') WHEN 1 THEN md5(text || c) ELSE md5('') END AS v, CASE WHEN k = 0 THEN 2 ELSE 0 END AS n_runs, CASE WHEN k = 0 THEN '7' END AS num_id, CASE WHEN k = 2 THEN 'word/media/' || doc_id || '.png' END AS path
  FROM p JOIN (VALUES (0), (1), (2), (3)) x(c) ON k = 1 OR c = 0
  UNION ALL SELECT doc_id, 'header', 'rId5', 0, 'paragraph', NULL, NULL, md5('head ' || doc_id), 0, NULL, NULL FROM documents""")
def layout_json_model(spark, d):
    """Paragraphs of two runs in a list, tables of two rows and images by number, with a header."""
    none = "cast(NULL AS {})".format
    run, cell = "struct<text:string>", "struct<cells:array<struct<text:string>>>"
    element = f"""CASE seq % 3 WHEN 0 THEN named_struct('type', 'paragraph', 'text', {none('string')}, 'm', {none('int')}, 'runs', array(named_struct('text', text), named_struct('text', '!')), 'list', named_struct('level', 1, 'numbering_id', '7'), 'rows', {none(f'array<{cell}>')})
      WHEN 1 THEN named_struct('type', 'table', 'text', {none('string')}, 'm', {none('int')}, 'runs', {none(f'array<{run}>')}, 'list', {none('struct<level:int,numbering_id:string>')}, 'rows', transform(array(0, 2), r -> named_struct('cells', transform(array(0, 1), c -> named_struct('text', concat(text, r + c))))))
      ELSE named_struct('type', 'image', 'text', '', 'm', 0, 'runs', {none(f'array<{run}>')}, 'list', {none('struct<level:int,numbering_id:string>')}, 'rows', {none(f'array<{cell}>')}) END"""
    body = para(spark, d).select("doc_id", "seq", F.expr(element).alias("e")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json("e").alias("e")))), lambda x: x["e"]).alias("body"))
    head = F.concat(F.lit('{"rId5":[{"type":"paragraph","text":"head '), "doc_id", F.lit('"}]}'))
    made = body.select("doc_id", F.concat(F.lit('{"media":[{"path":"word/media/'), "doc_id", F.lit('.png"}],"headers":'), head, F.lit(',"body":['), F.array_join("body", ","), F.lit("]}")).alias("json"))
    return J.model(made).select("doc_id", "part", "rel", "seq", "kind", "row_idx", "col_idx", F.md5(F.coalesce("text", F.lit(""))).alias("v"), "n_runs", "num_id", "path")


ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("html_pages", f"""
  SELECT doc_id, md5(string_agg(page, chr(10) ORDER BY n)) AS v FROM (SELECT doc_id, seq // 20 + 1 AS n, '<div class="page" data-page="' || (seq // 20 + 1) || '" style="position:relative;width:595pt;height:842pt">' ||
    string_agg('<div class="block" style="left:72.0pt;top:' || (seq % 20 * 30) || '.0pt;width:451.0pt;">' || {ESCAPED} || '</div>', '' ORDER BY seq) || '</div>' AS page FROM $PARA GROUP BY doc_id, seq // 20) GROUP BY doc_id""")
def html_pages(spark, d):
    return out.html_pages(placed(spark, d)).select("doc_id", F.md5("html").alias("v"))


@query("editable_html", f"SELECT doc_id, md5(string_agg('<p contenteditable=\"true\" data-seq=\"' || seq || '\">' || {ESCAPED} || '</p>', chr(10) ORDER BY seq)) AS v FROM $PARA GROUP BY doc_id")
def editable_html(spark, d):
    return out.editable_html(para(spark, d)).select("doc_id", F.md5("html").alias("v"))


@query("indent_combination", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 3 WHEN p_partkey % 4 <> 1 THEN p_partkey % 4 ELSE p_size END::DOUBLE AS v FROM part")
def indent_combination(spark, d):
    own = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size % 3 AS double) AS own", "if(p_partkey % 4 <> 1, cast(p_partkey % 4 AS double), NULL) AS level", "cast(p_size AS double) AS style")
    return own.select("p_partkey", I.combined("own", "level", "style").alias("v"))


@query("page_assembly")
def page_assembly(spark, d):
    """Lines of documents flow over A4 pages; every fifth is a table's row, others are images."""
    return A.assembled(A.measured(rows(spark, d)))


LIST_INDENTS = """WITH p AS (SELECT doc_id, seq, CASE WHEN seq % 11 <> 10 THEN seq % 3 END AS l, CASE WHEN seq % 11 <> 10 THEN length(text) % 4 END AS lvl FROM $PARA),
o AS (SELECT *, 1 + coalesce((lvl > 0 AND last_value(CASE WHEN lvl <= 0 THEN lvl END IGNORE NULLS) OVER w = 0)::INT, 0) + coalesce((lvl > 1 AND last_value(CASE WHEN lvl <= 1 THEN lvl END IGNORE NULLS) OVER w = 1)::INT, 0) + coalesce((lvl > 2 AND last_value(CASE WHEN lvl <= 2 THEN lvl END IGNORE NULLS) OVER w = 2)::INT, 0) AS n
  FROM p WINDOW w AS (PARTITION BY doc_id, l ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, l < 2 AND row_number() OVER w > 1 AS alike, CASE WHEN l < 2 THEN first_value(n * 18.0::DOUBLE) OVER w ELSE n * 18.0::DOUBLE END AS le, CASE WHEN l < 2 THEN first_value(n * l * 6.0::DOUBLE) OVER w ELSE n * l * 6.0::DOUBLE END AS ha
  FROM o WINDOW w AS (PARTITION BY doc_id, l < 2, lvl ORDER BY seq)),
m AS (SELECT *, CASE WHEN alike THEN 'auto-match' WHEN l = 1 AND lvl = 1 THEN 'manual' WHEN l IS NOT NULL THEN 'auto' ELSE 'none' END AS mode, greatest(CASE WHEN l < 2 THEN 21.0 ELSE 9.0 END - ha, 0)::DOUBLE AS room FROM b),
r AS (SELECT *, CASE WHEN mode LIKE 'auto%' THEN le + room ELSE le END AS x, CASE WHEN mode LIKE 'auto%' THEN ha + room ELSE ha END AS h FROM m),
u AS (SELECT *, median(CASE WHEN mode LIKE 'auto%' THEN x END) OVER (PARTITION BY doc_id, l, lvl) AS mid FROM r),
f AS (SELECT doc_id, seq, mode, CASE WHEN mode = 'none' THEN 12.0::DOUBLE WHEN mode <> 'manual' AND abs(x - mid) <= 9 THEN mid ELSE x END AS le, CASE WHEN mode = 'none' THEN 0.0::DOUBLE ELSE h END AS ha FROM u)
SELECT doc_id, seq, mode, greatest(le, 0.0)::DOUBLE AS text_start, greatest(le - ha, 0.0)::DOUBLE AS number_start, le AS "left", 0.0::DOUBLE AS "right", 0.0::DOUBLE AS first_line, ha AS hanging FROM f"""


@query("list_indents", LIST_INDENTS)
def list_indents(spark, d):
    """Lines of documents as items of three lists with up to four levels; every eleventh is a plain paragraph."""
    items = para(spark, d).selectExpr(
        "doc_id", "seq", "if(seq % 11 = 10, NULL, cast(seq % 3 AS string)) AS num_id", "length(text) % 4 AS level", "'' AS marker", "0D AS left", "0D AS right", "0D AS first_line", "0D AS hanging",
        "false AS explicit", "false AS style_is_list", "12D AS style_left", "0D AS style_right", "0D AS style_first_line", "0D AS style_hanging",
    )
    levels = spark.range(12).selectExpr(
        "cast(id % 3 AS string) AS num_id", "cast(id div 3 AS int) AS level", "18D AS left", "0D AS right", "0D AS first_line", "cast(id % 3 * 6 AS double) AS hanging", "if(id % 3 = 2, '', concat('%', id div 3 + 1, '.')) AS text", "'decimal' AS format", "id = 4 AS overridden",
    )
    return I.indented(items, levels)


@query("border_groups", "SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) WHERE event_type IN ('click', 'view') GROUP BY user_id, g HAVING count(*) > 1")
def border_groups(spark, d):
    own = table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS seq", "if(event_type IN ('click', 'view'), event_type, NULL) AS border")
    return B.border_groups(own, "border").select(F.col("doc_id").alias("user_id"), F.col("first_seq").alias("first_id"), F.col("last_seq").alias("last_id"), "n")


@query("autofit_widths", "SELECT l_suppkey AS table_id, kind AS col, CASE WHEN total > 60 THEN w * 60 / total ELSE w END AS width FROM (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM (SELECT l_suppkey, l_linenumber % 3 AS kind, greatest(max(l_quantity) + 10, 20) AS w FROM lineitem GROUP BY 1, 2))")
def autofit_widths(spark, d):
    own = table(spark, d, "lineitem").selectExpr("l_suppkey AS table_id", "l_linenumber % 3 AS col", "l_quantity AS w")
    return B.autofit_widths(own, "table_id", "col", "w", usable=60.0, padding=10.0)

