"""Element operators over lines of documents, template data and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import elements as E
from lamina.operators import styles as S
from lamina.plans.base import query, sql, table
from lamina.sinks import package as sink
from lamina.sources import html, package

KIND = "CASE WHEN seq % 5 = 3 THEN 'table' WHEN seq % 7 = 5 THEN 'image' ELSE 'paragraph' END"


def para(spark: SparkSession, d: str) -> DataFrame:
    return E.paragraphs(table(spark, d, "documents"))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return E.with_kinds(para(spark, d))


@query("placeholder_fill_orders", "SELECT o_orderkey, 'Dear ' || c_name || ', order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d.%m.%Y') || ' is {Unknown}' AS letter FROM orders JOIN customer ON c_custkey = o_custkey")
def placeholder_fill_orders(spark, d):
    data = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    values = {"TEXT:Name": "c_name", "NUM:Order": "cast(o_orderkey AS string)", "DATE:Day": T.date("o_orderdate")}
    return data.select("o_orderkey", S.filled(data, "'Dear {{ TEXT:Name }}, order {Order} of {{DATE:Day}} is {Unknown}'", values).alias("letter"))


@query("body_text", "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY seq)) AS v FROM $PARA WHERE text <> '' GROUP BY doc_id")
def body_text(spark, d):
    return E.joined_text(para(spark, d)).select("doc_id", F.md5("text").alias("v"))


@query("body_search", "SELECT doc_id, seq, s AS start, s + 3 AS \"end\", substr(text, greatest(s - 50, 0) + 1, s + 53 - greatest(s - 50, 0)) AS context FROM (SELECT doc_id, seq, text, unnest(list_filter(range(length(text)), lambda i: substr(lower(text), i + 1, 3) = 'ion')) AS s FROM $PARA)")
def body_search(spark, d):
    return E.search(para(spark, d), "ION").select("doc_id", "seq", "start", "end", "context")


@query("body_replace", "SELECT doc_id, seq, CAST(len(string_split(text, 'tion')) - 1 AS INT) AS n, md5(replace(text, 'tion', '$1')) AS v FROM $PARA")
def body_replace(spark, d):
    return E.replace(para(spark, d), "tion", "$1").select("doc_id", "seq", "n", F.md5("text").alias("v"))


@query("element_paths", f"SELECT doc_id, seq, 'body.' || kind || '[' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY seq) - 1) || ']' AS path FROM (SELECT *, {KIND} AS kind FROM $PARA)")
def element_paths(spark, d):
    return E.paths(rows(spark, d)).select("doc_id", "seq", "path")


@query("document_structure", f"""SELECT doc_id, total, paragraphs, tables, images, round(paragraphs / total, 9) AS density,
  CASE WHEN paragraphs >= tables AND paragraphs >= images THEN 'text_heavy' WHEN tables >= images THEN 'table_heavy' ELSE 'image_heavy' END AS balance,
  CASE WHEN tables > paragraphs THEN 'table_heavy' WHEN images > paragraphs THEN 'image_heavy' WHEN boxes > 0 THEN 'mixed_layout' WHEN paragraphs > 10 THEN 'text_heavy' ELSE 'simple' END AS doc_type,
  CASE WHEN s >= 10 THEN 'high' WHEN s >= 5 THEN 'medium' ELSE 'low' END AS complexity
  FROM (SELECT *, tscore + CASE WHEN total > 50 THEN 3 WHEN total > 20 THEN 2 WHEN total > 10 THEN 1 ELSE 0 END AS s FROM (SELECT doc_id, count(*) AS total, count_if(kind = 'paragraph')::BIGINT AS paragraphs, count_if(kind = 'table')::BIGINT AS tables, count_if(kind = 'image')::BIGINT AS images, count_if(kind = 'textbox') AS boxes, coalesce(sum(CASE WHEN kind = 'table' THEN seq % 4 END), 0) AS tscore FROM (SELECT * REPLACE (CASE WHEN seq = 17 THEN 'textbox' ELSE kind END AS kind) FROM (SELECT *, {KIND} AS kind FROM $PARA)) GROUP BY doc_id))""")
def document_structure(spark, d):
    own = rows(spark, d).withColumns({"kind": F.expr("if(seq = 17, 'textbox', kind)"), "score": F.expr("seq % 4")})
    return E.structure(own).select("doc_id", "total", "paragraphs", "tables", "images", F.round("paragraph_density", 9).alias("density"), "balance", "doc_type", "complexity")


@query("reading_order", f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'paragraph' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, y, x, seq) AS position FROM (SELECT *, {KIND} AS kind, length(text) % 9 AS y, seq % 4 AS x FROM $PARA)")
def reading_order(spark, d):
    return E.reading_order(rows(spark, d).withColumns({"y": F.length("text") % 9, "x": F.col("seq") % 4})).select("doc_id", "seq", F.col("position").cast("long").alias("position"))


def items(spark, d):
    return para(spark, d).select("doc_id", "seq", (F.length("text") % 2).alias("num_id"), (F.col("seq") % 4).alias("level"))


ITEMS = "SELECT doc_id, seq, length(text) % 2 AS num_id, seq % 4 AS level FROM $PARA"


@query("flat_list_counters", f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, num_id, level ORDER BY seq) AS counter FROM ({ITEMS})")
def flat_list_counters(spark, d):
    return E.flat_counters(items(spark, d)).select("doc_id", "seq", F.col("counter").cast("long").alias("counter"))


@query("scoped_list_counters", f"SELECT doc_id, seq, parent_seq, row_number() OVER (PARTITION BY doc_id, num_id, level, parent_seq ORDER BY seq) AS counter FROM (SELECT a.doc_id, a.seq, a.num_id, a.level, max(b.seq) AS parent_seq FROM ({ITEMS}) a LEFT JOIN ({ITEMS}) b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY ALL)")
def scoped_list_counters(spark, d):
    return E.scoped_counters(items(spark, d)).select("doc_id", "seq", "parent_seq", F.col("counter").cast("long").alias("counter"))


@query("run_islands", "SELECT doc_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, bold, md5(string_agg(text, '' ORDER BY seq)) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM (SELECT *, CASE WHEN lag(bold) OVER (PARTITION BY doc_id ORDER BY seq) = bold THEN 0 ELSE 1 END AS new FROM (SELECT *, length(text) % 3 = 0 AS bold FROM $PARA))) GROUP BY doc_id, g, bold")
def run_islands(spark, d):
    return E.islands(para(spark, d).withColumn("bold", F.length("text") % 3 == 0), "bold").select("doc_id", "first_seq", "last_seq", "n", "bold", F.md5("text").alias("v"))


@query("note_numbers", "SELECT doc_id, note_id, min(seq) AS first_seq, dense_rank() OVER (PARTITION BY doc_id ORDER BY min(seq), note_id) AS number FROM (SELECT doc_id, seq, length(text) % 11 AS note_id FROM $PARA) GROUP BY doc_id, note_id")
def note_numbers(spark, d):
    return E.note_numbers(para(spark, d).select("doc_id", "seq", (F.length("text") % 11).alias("note_id"))).select("doc_id", "note_id", "first_seq", F.col("number").cast("long").alias("number"))


@query("style_dictionary", "SELECT doc_id, seq, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS style_id FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, length(text) % 5) AS f FROM $PARA)")
def style_dictionary(spark, d):
    return E.style_dictionary(para(spark, d).withColumn("size", F.length("text") % 5), "size").select("doc_id", "seq", F.col("style_id").cast("long").alias("style_id"))


WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
SO_FAR = "(CASE WHEN a.d = '' THEN '' ELSE a.d || chr(10) END)"
WRAPPED = f"list_reduce(list_prepend({{'d': '', 'l': '', 'c': 0}}, list_transform({WORDS}, lambda w: {{'d': '', 'l': w, 'c': length(w)::INT}})), lambda a, x: CASE WHEN a.c + x.c + 1 <= 60 THEN {{'d': a.d, 'l': CASE WHEN a.l = '' THEN x.l ELSE a.l || ' ' || x.l END, 'c': (a.c + x.c + 1)::INT}} WHEN a.l <> '' THEN {{'d': {SO_FAR} || a.l, 'l': x.l, 'c': x.c}} ELSE {{'d': {SO_FAR} || x.l, 'l': '', 'c': 0}} END)"
HEIGHT = f"CASE kind WHEN 'paragraph' THEN greatest(1, length(text) // 80) * 12 * 1.2::DOUBLE * 0.35::DOUBLE WHEN 'image' THEN 50 ELSE 40 END::DOUBLE"


@query("word_wrap", f"SELECT doc_id, seq, md5(v) AS v, len(string_split(v, chr(10)))::INT AS n FROM (SELECT doc_id, seq, CASE WHEN text = '' THEN '' WHEN a.l = '' THEN a.d ELSE {SO_FAR} || a.l END AS v FROM (SELECT doc_id, seq, text, {WRAPPED} AS a FROM $PARA))")
def word_wrap(spark, d):
    return E.wrapped(para(spark, d), 60).select("doc_id", "seq", F.md5("wrapped").alias("v"), F.size(F.split("wrapped", "\n")).alias("n"))


@query("metric_line_counts", f"SELECT doc_id, seq, (r.n + (r.c > 0)::INT)::INT AS n FROM (SELECT doc_id, seq, list_reduce(list_prepend({{'n': 0, 'c': 0}}, list_transform({WORDS}, lambda w: {{'n': 0, 'c': length(w)::INT}})), lambda a, x: CASE WHEN a.c > 0 AND a.c + x.c + 1 > 68 THEN {{'n': (a.n + 1)::INT, 'c': (x.c + 1)::INT}} ELSE {{'n': a.n, 'c': (a.c + x.c + 1)::INT}} END) AS r FROM $PARA)")
def metric_line_counts(spark, d):
    return para(spark, d).select("doc_id", "seq", F.expr(T.metric_lines("text", 451.0, 11.0)).alias("n"))


@query("pagination", f"WITH RECURSIVE b AS (SELECT doc_id, seq, {HEIGHT} AS h FROM (SELECT *, {KIND} AS kind FROM $PARA)), p AS (SELECT doc_id, seq, h, CASE WHEN 25.4::DOUBLE + h > 25.4::DOUBLE + 246.2::DOUBLE THEN 2 ELSE 1 END AS page, 25.4::DOUBLE AS y FROM b WHERE seq = 0 UNION ALL SELECT b.doc_id, b.seq, b.h, CASE WHEN p.y + p.h + b.h > 25.4::DOUBLE + 246.2::DOUBLE THEN p.page + 1 ELSE p.page END, CASE WHEN p.y + p.h + b.h > 25.4::DOUBLE + 246.2::DOUBLE THEN 25.4::DOUBLE ELSE p.y + p.h END FROM p JOIN b ON b.doc_id = p.doc_id AND b.seq = p.seq + 1) SELECT doc_id, seq, page, round(y, 6) AS y FROM p")
def pagination(spark, d):
    return E.paginated(E.with_heights(rows(spark, d))).select("doc_id", "seq", "page", F.round("y", 6).alias("y"))


@query("block_heights", f"SELECT doc_id, seq, round(CASE kind WHEN 'paragraph' THEN greatest(1, length(text) // 80) * 12 * 1.2::DOUBLE * 0.35::DOUBLE WHEN 'image' THEN 50 ELSE 40 END, 6) AS h FROM (SELECT *, {KIND} AS kind FROM $PARA)")
def block_heights(spark, d):
    return E.with_heights(rows(spark, d)).select("doc_id", "seq", F.round("h", 6).alias("h"))


@query("merge_append", f"SELECT doc_id, md5(text) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY side, part, seq) - 1 AS seq FROM (SELECT doc_id, seq, text, 0 AS side, 0 AS part FROM $PARA UNION ALL SELECT doc_id, seq, text || '!', 1, CASE kind WHEN 'paragraph' THEN 0 ELSE 1 END FROM (SELECT *, {KIND} AS kind FROM $PARA) WHERE kind <> 'image')")
def merge_append(spark, d):
    own = rows(spark, d)
    return E.merged(own, own.withColumn("text", F.concat("text", F.lit("!")))).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("v"))


@query("positional_compare", "SELECT doc_id, change, count(*) AS n FROM (SELECT doc_id, CASE WHEN seq % 6 = 5 THEN 'untouched' WHEN seq % 4 = 3 THEN 'changed' ELSE 'same' END AS change FROM $PARA) GROUP BY 1, 2")
def positional_compare(spark, d):
    left = para(spark, d)
    right = left.filter("seq % 6 <> 5").withColumn("text", F.when(F.col("seq") % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return E.positional(left, right).groupBy("doc_id", "change").agg(F.count("*").alias("n"))


@query("validation_issues", "SELECT doc_id, seq, unnest(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN length(text) > 500 THEN 'long' END, CASE WHEN text LIKE '%  %' THEN 'blanks' END], lambda x: x IS NOT NULL)) AS rule FROM $PARA")
def validation_issues(spark, d):
    return E.issues(para(spark, d), empty=F.col("text") == "", long=F.length("text") > 500, blanks=F.contains("text", F.lit("  ")))


@query("dangling_labels", "SELECT o_orderkey % 3 AS doc_id, o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0 AND c_custkey % 3 = o_orderkey % 3)")
def dangling_labels(spark, d):
    """A label that another document has is none of this one."""
    labels = table(spark, d, "customer").filter("c_custkey % 10 <> 0").selectExpr("c_custkey % 3 AS doc_id", "c_custkey")
    return S.dangling(table(spark, d, "orders").selectExpr("o_orderkey % 3 AS doc_id", "o_orderkey", "o_custkey"), "o_custkey", labels, "c_custkey")


def styles(spark, d):
    parts = table(spark, d, "part")
    return parts.crossJoin(spark.range(2).withColumnRenamed("id", "doc_id")).select("doc_id", F.col("p_partkey").cast("string").alias("style_id"), F.when(F.col("p_partkey") % 8 != 0, F.floor(F.col("p_partkey") / 8).cast("string")).alias("based_on"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.concat(F.lit("k"), F.col("p_partkey") % 3), F.concat_ws("-", "p_brand", "doc_id")).alias("properties"))


STYLES = "WITH RECURSIVE st AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 8 <> 0 THEN (p_partkey // 8)::VARCHAR END AS base, p_size, p_brand, 'k' || (p_partkey % 3) AS k FROM part), up AS (SELECT id, id AS a, base, 0 AS depth FROM st UNION ALL SELECT up.id, st.id, st.base, depth + 1 FROM up JOIN st ON st.id = up.base) "


@query("style_chains", STYLES + "SELECT doc_id, id AS style_id, a AS ancestor, depth FROM up, range(2) t(doc_id)")
def style_chains(spark, d):
    return S.chains(styles(spark, d))


@query("style_inheritance", STYLES + ", p AS (SELECT up.id, depth, doc_id, unnest([('size', p_size::VARCHAR), (k, p_brand || '-' || doc_id)]) AS x FROM up JOIN st ON st.id = up.a, range(2) t(doc_id)) SELECT doc_id, id AS style_id, x[1] AS name, arg_min(x[2], depth) AS value FROM p GROUP BY 1, 2, 3")
def style_inheritance(spark, d):
    return S.resolved(styles(spark, d)).select("doc_id", "style_id", F.explode("properties").alias("name", "value"))


@query("style_overlay", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, ''), p_type) AS a, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS kept FROM part")
def style_overlay(spark, d):
    own = table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.create_map(F.lit("a"), "p_type").alias("base"), F.create_map(F.lit("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).alias("over"), F.create_map(F.lit("n"), "p_name").alias("local"), F.create_map(F.lit("n"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("x")).alias("definition"))
    return own.select("p_partkey", S.overlay("base", "over")["a"].alias("a"), S.without_defaults("local", "definition")["n"].alias("kept"))


@query("relationship_lookup", "SELECT s_suppkey, n_name AS target FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def relationship_lookup(spark, d):
    return S.lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", table(spark, d, "nation"), "n_nationkey", F.col("n_name").alias("target")).select("s_suppkey", "target")


@query("table_csv", "SELECT l_orderkey AS doc_id, array_to_string(list_sort(list(l_linenumber || ',' || l_returnflag || ',\"' || l_linestatus || ',' || l_partkey || '\"')), chr(10)) AS csv FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def table_csv(spark, d):
    own = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    cells = F.array(F.col("l_linenumber").cast("string"), "l_returnflag", F.concat_ws(",", "l_linestatus", "l_partkey"))
    return sink.delimited(own.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", cells.alias("cells")), "doc_id", "l_linenumber", "cells")


@query("layout_json", "SELECT doc_id, count(*) AS blocks, md5(string_agg(text, '|' ORDER BY seq)) AS v FROM $PARA GROUP BY doc_id")
def layout_json(spark, d):
    block = F.struct("seq", F.struct("seq", F.lit("paragraph").alias("t"), F.col("text").alias("c")).alias("b"))
    written = para(spark, d).groupBy("doc_id").agg(F.to_json(F.struct(F.lit("2.0").alias("version"), F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))).alias("json"))
    read = written.select("doc_id", F.from_json("json", "version string, blocks array<struct<seq:int,t:string,c:string>>").alias("j"))
    return read.select("doc_id", F.size("j.blocks").cast("long").alias("blocks"), F.md5(F.array_join(F.col("j.blocks")["c"], "|")).alias("v"))


@query("html_elements")
def html_elements(spark, d):
    return html.scan_pages(table(spark, d, "pages")).select("page_id", "seq", "kind", "text", "list_level", "list_format")


@query("package_round_trip", "SELECT doc_id, seq, md5(text) AS v FROM $PARA")
def package_round_trip(spark, d):
    packed = sink.write_packages(table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines")), "doc_id", "lines")
    found = package.scan(packed, "elements", "doc_id").filter("kind = 'paragraph'")
    return found.select("doc_id", "seq", F.md5("text").alias("v"))

