"""Lookups, reports, value rules and template blocks: each query calls the library, the oracle says the rule another way."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina import plugins
from lamina.functions import formats
from lamina.functions import values as V
from lamina.operators import elements as E
from lamina.operators import fill
from lamina.operators import lookups as L
from lamina.operators import merging as M
from lamina.operators import reports as R
from lamina.operators import styles as S
from lamina.operators import templates as P
from lamina.plans.base import blocks, query, sql, table, PARA_DUCK
from lamina.plans.element_queries import para
from lamina.sinks import text as sink
from lamina.sources import media

# --- filters and lookups ---------------------------------------------------------------------------------------------------------------

STYLE = "if(seq = 0, 'Heading 1', if(seq % 3 = 0, 'Quote', NULL)) AS style"
STYLED_DUCK = "(SELECT doc_id, seq, text, CASE WHEN seq = 0 THEN 'Heading 1' WHEN seq % 3 = 0 THEN 'Quote' END AS style FROM $PARA)"


@query("elements_by_style", f"SELECT doc_id, seq FROM {STYLED_DUCK} WHERE style = 'Quote'")
def elements_by_style(spark, d):
    return L.by_style(para(spark, d).selectExpr("doc_id", "seq", STYLE), "Quote").select("doc_id", "seq")


@query("styles_by_type", "SELECT p_partkey AS style_id, p_brand FROM part WHERE p_type = 'PROMO'")
def styles_by_type(spark, d):
    return L.of_type(table(spark, d, "part").withColumnRenamed("p_type", "type"), "PROMO").select(F.col("p_partkey").alias("style_id"), "p_brand")


@query("style_by_name", "SELECT p_size AS doc_id, min(p_partkey) AS style_id FROM part WHERE p_type = 'ECONOMY' GROUP BY 1")
def style_by_name(spark, d):
    own = table(spark, d, "part").selectExpr("p_size AS doc_id", "p_partkey AS style_id", "p_type AS name")
    return L.first_named(own, "ECONOMY", order="style_id").select("doc_id", "style_id")



@query("image_relationships", "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 4 < 3")
def image_relationships(spark, d):
    own = table(spark, d, "events").selectExpr("event_id", "if(event_type = 'view', 'image', event_type) AS type", "element_at(array('word/document.xml', 'word/header2.xml', 'word/footer1.xml', 'word/footnotes.xml'), cast(event_id % 4 + 1 AS int)) AS source")
    return L.image_relationships(L.relationships_of(own, "image")).select("event_id")


@query("fonts_in_range", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size BETWEEN 10 AND 20 UNION ALL SELECT p_partkey FROM part WHERE p_size >= 45")
def fonts_in_range(spark, d):
    own = table(spark, d, "part").withColumnRenamed("p_size", "size")
    return L.sized(L.of_type(own, "PROMO", "p_type"), 10, 20).select("p_partkey").unionByName(L.sized(own, 45).select("p_partkey"))


@query("media_by_type", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 1")
def media_by_type(spark, d):
    own = table(spark, d, "part").selectExpr("p_partkey", "element_at(array(X'25504446', X'89504E470D0A', X'504B0304'), cast(p_partkey % 3 + 1 AS int)) AS b").withColumn("type", F.expr(formats.media_class("b")))
    return L.of_type(own, "image").select("p_partkey")


@query("issues_by_level", f"SELECT doc_id, seq, 'error' AS level FROM {PARA_DUCK} WHERE length(text) = 0 UNION ALL SELECT doc_id, seq, 'warning' FROM {PARA_DUCK} WHERE length(text) > 400")
def issues_by_level(spark, d):
    found = E.issues(para(spark, d), error=F.char_length("text") == 0, warning=F.char_length("text") > 400, info=F.char_length("text") < 20)
    return L.of_level(found.withColumnRenamed("rule", "level"), "error", "warning").select("doc_id", "seq", "level")


@query("tables_by_style", "SELECT l_orderkey AS table_id, count(*) AS n_rows FROM lineitem WHERE l_orderkey % 4 = 1 GROUP BY 1")
def tables_by_style(spark, d):
    own = table(spark, d, "lineitem").selectExpr("l_orderkey AS table_id", "3 AS cells", "if(l_orderkey % 4 = 1, 'Grid', 'Plain') AS style")
    return R.dimensions(L.by_style(own, "Grid"), "table_id", "cells").select("table_id", "n_rows")


KINDS = "['paragraph', 'table', 'image', 'section', 'textbox', 'cell', 'hyperlink', NULL, 'footnote', 'header', 'comment', 'bookmark', 'numbering', 'endnote', 'field', 'style_ref']"


@query("element_categories", "SELECT event_id, ['text', 'table', 'graphical', 'structural', 'graphical', 'table', 'text', 'structural', 'layout', 'layout', 'meta', 'meta', 'style', 'layout', 'text', 'style'][event_id % 16 + 1] AS category FROM events")
def element_categories(spark, d):
    own = table(spark, d, "events").selectExpr("event_id", f"element_at(array{KINDS.replace('[', '(').replace(']', ')')}, cast(event_id % 16 + 1 AS int)) AS kind")
    return own.select("event_id", L.category().alias("category"))


@query("nested_elements", "SELECT doc_id, seq FROM $PARA WHERE seq % 4 > 0")
def nested_elements(spark, d):
    own = para(spark, d).selectExpr("doc_id", "seq", "concat('body.', if(seq % 4 = 0, 'paragraph', if(seq % 4 = 1, 'table[0].cell', 'table[0].cell.table[0].cell')), '[', seq, ']') AS path", "if(seq % 4 = 0, 'paragraph', 'cell') AS kind")
    return L.inside(own, "body.table[0]", "cell").select("doc_id", "seq")


@query("element_by_path", "SELECT doc_id, seq, md5(text) AS v FROM $PARA WHERE seq = 2")
def element_by_path(spark, d):
    return L.by_id(E.paths(para(spark, d).withColumn("kind", F.lit("paragraph"))), "body.paragraph[2]", "path").select("doc_id", "seq", F.md5("text").alias("v"))


@query("page_links", "SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def page_links(spark, d):
    return L.links(table(spark, d, "pages"))


@query("link_classes", "SELECT page_id, regexp_matches(url, '^[a-z]+://[^/]+') AS external, url LIKE '#%' AS internal, CASE WHEN url LIKE '#%' THEN 'anchor' WHEN url LIKE 'mailto:%' THEN 'email' WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'file' END AS target FROM pages")
def link_classes(spark, d):
    return table(spark, d, "pages").select("page_id", L.is_external("url").alias("external"), F.col("url").startswith("#").alias("internal"), L.link_target("url").alias("target"))


@query("link_summary", "SELECT target, count(*) AS n FROM (SELECT CASE WHEN l LIKE '#%' THEN 'anchor' WHEN l LIKE 'mailto:%' THEN 'email' WHEN regexp_matches(l, '^https?://') THEN 'url' ELSE 'file' END AS target FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS l FROM pages)) GROUP BY 1")
def link_summary(spark, d):
    return L.links(table(spark, d, "pages")).groupBy(L.link_target("link").alias("target")).agg(F.count("*").alias("n"))


@query("comments_in_range", "SELECT event_id, event_type AS author, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def comments_in_range(spark, d):
    span = [F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-09")]
    return L.between(table(spark, d, "events"), "ts", *span).select("event_id", F.col("event_type").alias("author"), "ts")


@query("customer_by_type", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_acctbal <= 5000")
def customer_by_type(spark, d):
    return L.sized(L.of_type(table(spark, d, "customer"), "BUILDING", "c_mktsegment"), 0, 5000, "c_acctbal").select("c_custkey", "c_name")


# --- summaries and reports -------------------------------------------------------------------------------------------------------------


@query("comments_by_author", "SELECT role AS author, count(*) AS total, count(DISTINCT conv_id) AS threads, sum(length(text))::BIGINT AS characters, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY role")
def comments_by_author(spark, d):
    return R.comments_by(table(spark, d, "conversations"), "role", "conv_id").withColumn("mean_length", F.round("mean_length", 6))


@query("value_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lo, max(value) AS hi, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def value_summary(spark, d):
    return R.value_summary(table(spark, d, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "median", "sd")})


@query("media_summary", "SELECT p_size AS doc_id, count(*) AS total, sum(length(p_name))::BIGINT AS bytes, count_if(p_partkey % 3 = 0)::BIGINT AS image, count_if(p_partkey % 3 = 1)::BIGINT AS other FROM part GROUP BY 1")
def media_summary(spark, d):
    own = table(spark, d, "part").selectExpr("p_size AS doc_id", "length(p_name) AS size", "element_at(array('image', 'other', 'pdf'), cast(p_partkey % 3 + 1 AS int)) AS type")
    return R.media_summary(own).select("doc_id", "total", "bytes", "image", "other")


@query("media_dictionary", "SELECT p_size AS doc_id, p_type AS path, (row_number() OVER (PARTITION BY p_size ORDER BY min(p_partkey)) - 1)::INT AS id FROM part GROUP BY 1, 2")
def media_dictionary(spark, d):
    return R.media_dictionary(table(spark, d, "part").selectExpr("p_size AS doc_id", "p_type AS path", "p_partkey AS seq"))


@query("id_stats", "SELECT user_id AS doc_id, event_type AS type, sum(n)::BIGINT AS n, count(*) AS \"distinct\", count_if(n > 1)::BIGINT AS clashes FROM (SELECT user_id, event_type, event_id % 7 AS id, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def id_stats(spark, d):
    return R.id_stats(table(spark, d, "events").selectExpr("user_id AS doc_id", "event_type AS type", "cast(event_id % 7 AS string) AS id"))


@query("hit_rates", "SELECT user_id, count_if(event_type = 'view')::BIGINT AS hits, round(count_if(event_type = 'view') / count(*), 9) AS rate FROM events GROUP BY user_id")
def hit_rates(spark, d):
    return R.hit_rates(table(spark, d, "events"), F.col("event_type") == "view", "user_id").withColumn("rate", F.round("rate", 9))


@query("soonest_expiring", "SELECT event_type, arg_min(event_id, (ts, event_id)) AS evicted FROM events GROUP BY event_type")
def soonest_expiring(spark, d):
    return R.evicted(table(spark, d, "events"), "ts", "event_id", "event_type")


@query("least_recent", "SELECT user_id % 5 AS cache, arg_min(event_type, (seen, event_type)) AS evicted FROM (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY 1, 2) GROUP BY 1")
def least_recent(spark, d):
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("seen")).withColumn("cache", F.col("user_id") % 5)
    return R.evicted(seen, "seen", "event_type", "cache")


@query("style_hierarchy_text", "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def style_hierarchy_text(spark, d):
    own = S.lookup(table(spark, d, "nation"), "n_regionkey", table(spark, d, "region"), "r_regionkey", "r_name")
    return R.hierarchy_text(own, "r_name", "n_name").withColumnRenamed("children", "nations")


@query("table_column_widths", "SELECT p_size, max(length(p_name))::INT AS p_name, max(length(p_brand))::INT AS p_brand, max(length(p_partkey::VARCHAR))::INT AS p_partkey FROM part GROUP BY 1")
def table_column_widths(spark, d):
    return R.column_widths(table(spark, d, "part"), "p_size", "p_name", "p_brand", "p_partkey")


@query("text_table", "SELECT p_partkey, rpad(p_name, w.a::INT, ' ') || ' | ' || rpad(p_brand, w.b::INT, ' ') AS line FROM part JOIN (SELECT p_size, max(length(p_name)) AS a, max(length(p_brand)) AS b FROM part GROUP BY 1) w USING (p_size)")
def text_table(spark, d):
    return R.text_table(table(spark, d, "part"), "p_size", "p_name", "p_brand").select("p_partkey", "line")


@query("markdown_table", "SELECT p_partkey, '| ' || p_name || '\\|x | ' || p_brand || ' | ' || p_size || ' |' AS line FROM part")
def markdown_table(spark, d):
    """A bar in a cell is escaped."""
    return table(spark, d, "part").withColumn("p_name", F.concat("p_name", F.lit("|x"))).select("p_partkey", R.markdown_line("p_name", "p_brand", "p_size").alias("line"))


@query("table_dimensions", "SELECT l_orderkey, count(*) AS n_rows, sum(n)::BIGINT AS cells, min(n) AS lo, max(n) AS hi, round(avg(n), 6) AS mean, min(n) = max(n) AS regular FROM (SELECT l_orderkey, 3 + l_linenumber % 2 AS n FROM lineitem) GROUP BY l_orderkey")
def table_dimensions(spark, d):
    return R.dimensions(table(spark, d, "lineitem").withColumn("n", F.expr("3 + l_linenumber % 2")), "l_orderkey", "n").withColumn("mean", F.round("mean", 6))


@query("sequence_check", "SELECT user_id, bool_and(v > coalesce(b, -1)) AS ok FROM (SELECT user_id, event_id % 97 AS v, lag(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1")
def sequence_check(spark, d):
    return R.in_sequence(table(spark, d, "events").withColumn("v", F.expr("event_id % 97")), "user_id", "event_id", "v")


@query("lost_and_gained", "SELECT 'lost' AS what, name AS value FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 25) WHERE name NOT IN (SELECT p_name FROM part WHERE p_size >= 20) UNION ALL SELECT 'gained', name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size >= 20) WHERE name NOT IN (SELECT p_name FROM part WHERE p_size < 25)")
def lost_and_gained(spark, d):
    part = table(spark, d, "part")
    return R.lost_and_gained(part.filter("p_size < 25"), part.filter("p_size >= 20"), "p_name")


@query("revision_history", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS revision, role AS author, md5(text) AS v FROM conversations")
def revision_history(spark, d):
    return R.revisions(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "revision", "author", F.md5("text").alias("v"))


@query("block_identity", "SELECT conv_id, turn, 'b' || conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS uid FROM conversations")
def block_identity(spark, d):
    return R.block_ids(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "uid")


@query("issue_reports", """SELECT doc_id, errors, warnings, md5(text) AS t, n FROM (SELECT doc_id, count_if(level = 'error')::INT AS errors, count_if(level = 'warning')::INT AS warnings, count(*)::INT AS n, string_agg(upper(level) || ': ' || rule || ' (' || element || ')', chr(10) ORDER BY level, rule, element) AS text
  FROM (SELECT doc_id, 'error' AS level, 'empty' AS rule, seq::VARCHAR AS element FROM $PARA WHERE length(text) = 0 UNION ALL SELECT doc_id, 'warning', 'long', seq::VARCHAR FROM $PARA WHERE length(text) > 400) GROUP BY doc_id)""")
def issue_reports(spark, d):
    found = E.issues(para(spark, d), empty=F.char_length("text") == 0, long=F.char_length("text") > 400)
    report = R.issue_report(found.select("doc_id", F.when(F.col("rule") == "empty", "error").otherwise("warning").alias("level"), "rule", F.col("seq").cast("string").alias("element")))
    return report.select("doc_id", "errors", "warnings", F.md5("text").alias("t"), F.json_array_length("json").alias("n"))


@query("package_issues", """WITH o AS (SELECT n_nationkey AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN ['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/styles.xml', 'word/media/a.png'] WHEN 1 THEN ['[Content_Types].xml', 'word/document.xml'] ELSE ['[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/styles.xml', 'word/numbering.xml', 'word/settings.xml', 'word/theme/theme1.xml', 'docProps/core.xml', 'docProps/app.xml'] END AS p FROM $NATION)
  SELECT doc_id, 'error' AS level, 'missing_part' AS rule, e AS element FROM (SELECT doc_id, p, unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml']) AS e FROM o) WHERE NOT list_contains(p, e)
  UNION ALL SELECT doc_id, 'warning', 'missing_part', e FROM (SELECT doc_id, p, unnest(['word/styles.xml', 'word/numbering.xml', 'word/settings.xml', 'word/theme/theme1.xml', 'docProps/core.xml', 'docProps/app.xml']) AS e FROM o) WHERE NOT list_contains(p, e)
  UNION ALL SELECT doc_id, 'warning', 'no_content_type', 'word/media/a.png' FROM o WHERE list_contains(p, 'word/media/a.png')
  UNION ALL SELECT doc_id, 'error', 'broken_target', 'rId1' FROM o WHERE NOT list_contains(p, 'word/media/a.png')
  UNION ALL SELECT doc_id, 'error', 'broken_target', 'rId3' FROM o WHERE NOT list_contains(p, 'docProps/app.xml')""")
def package_issues(spark, d):
    lists = "if(n_nationkey % 3 = 0, array('[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/styles.xml', 'word/media/a.png'), if(n_nationkey % 3 = 1, array('[Content_Types].xml', 'word/document.xml'), array('[Content_Types].xml', '_rels/.rels', 'word/document.xml', 'word/styles.xml', 'word/numbering.xml', 'word/settings.xml', 'word/theme/theme1.xml', 'docProps/core.xml', 'docProps/app.xml')))"
    nation = blocks(spark, d)
    parts = nation.selectExpr("n_nationkey AS doc_id", f"explode({lists}) AS part").withColumn("content_type", F.when(~F.col("part").endswith(".png"), "application/xml"))
    rels = nation.selectExpr("n_nationkey AS doc_id", "'word/document.xml' AS source", "inline(array(named_struct('rel_id', 'rId1', 'target', 'media/a.png', 'target_mode', 'Internal'), named_struct('rel_id', 'rId2', 'target', 'http://x.org', 'target_mode', 'External'), named_struct('rel_id', 'rId3', 'target', '../docProps/app.xml', 'target_mode', CAST(NULL AS string)), named_struct('rel_id', 'rId4', 'target', '/word/document.xml', 'target_mode', 'Internal')))")
    return R.package_issues(parts, rels)


@query("property_issues", "SELECT p_partkey AS doc_id, 'bad_count' AS rule, 'Pages' AS name FROM part WHERE p_partkey % 4 IN (1, 2) UNION ALL SELECT p_partkey, 'no_name', NULL FROM part WHERE p_partkey % 5 = 0")
def property_issues(spark, d):
    own = table(spark, d, "part").selectExpr("p_partkey AS doc_id", "inline(array(named_struct('name', 'Pages', 'value', element_at(array(cast(p_size AS string), '-1', 'many', '0'), cast(p_partkey % 4 + 1 AS int))), named_struct('name', if(p_partkey % 5 = 0, NULL, 'Company'), 'value', p_name)))")
    return R.property_issues(own)


# --- values ----------------------------------------------------------------------------------------------------------------------------

sql("coerced_properties", f"SELECT p_partkey, c.number, c.flag, cast(cast(c.moment AS date) AS string) AS day, c.text FROM (SELECT p_partkey, {V.coerced('v', 'k')} AS c FROM (SELECT p_partkey, element_at(array('i4', 'bool', 'created', 'app', 'lpwstr'), cast(p_partkey % 5 + 1 AS int)) AS k, element_at(array(' 12 ', 'True', '2024-02-03T04:05:06Z', cast(p_size AS string), p_name), cast(p_partkey % 5 + 1 AS int)) AS v FROM part))",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 12.0::DOUBLE WHEN 3 THEN p_size::DOUBLE END AS number, CASE WHEN p_partkey % 5 = 1 THEN true END AS flag, CASE WHEN p_partkey % 5 = 2 THEN '2024-02-03' END AS day, ['12', 'True', '2024-02-03T04:05:06Z', p_size::VARCHAR, p_name][p_partkey % 5 + 1] AS text FROM part")
sql("half_points", f"SELECT p_partkey, {V.half_points('s')} AS v FROM (SELECT p_partkey, element_at(array('', concat(p_size, '.5'), 'big', cast(p_size AS string)), cast(p_partkey % 4 + 1 AS int)) AS s FROM part)",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN (p_size * 2 + 1)::VARCHAR WHEN 2 THEN 'big' WHEN 3 THEN (p_size * 2)::VARCHAR END AS v FROM part")
sql("color_validity", f"SELECT p_partkey, {V.valid_color('c')} AS ok, {V.valid_channels('p_size * 6', '255', '0')} AS channels FROM (SELECT p_partkey, p_size, element_at(array('#a1b', '#00FF7f', 'Orange', '#12345', 'nope', NULL), cast(p_partkey % 6 + 1 AS int)) AS c FROM part)",
    "SELECT p_partkey, p_partkey % 6 < 3 AS ok, p_size <= 42 AS channels FROM part")
sql("date_pictures", f"SELECT event_id, {V.shown('ts', 'dddd, d MMMM yyyy')} AS a, {V.shown('ts', 'dd.MM.yy HH:mm')} AS b, {V.shown('ts', 'ddd MMM dd hh:mm:ss AM/PM')} AS c FROM events",
    "SELECT event_id, strftime(ts, '%A, d %B %Y') AS a, strftime(ts, '%d.%m.%y %H:%M') AS b, strftime(ts, '%a %b %d %I:%M:%S %p') AS c FROM events")
XML = "concat('<?xml version=\"1.0\"?>\\n<w:p xmlns:w=\"urn:w\">  <w:r w:id=\"', p_partkey, '\">\\n<w:t>', p_name, '</w:t></w:r> <w:t>', p_size, '</w:t>\\n</w:p>')"
sql("xml_texts", f"SELECT p_partkey, array_join({V.xml_text(XML, 't')}, '|') AS v, {V.xml_count(XML, 't')} AS n, {V.xml_attribute(XML, 'r', 'id')} AS id FROM part", "SELECT p_partkey, p_name || '|' || p_size AS v, 2 AS n, p_partkey::VARCHAR AS id FROM part", deal=True)
sql("xml_normalized", f"SELECT p_partkey, {V.normalized_xml(XML)} AS v FROM part", "SELECT p_partkey, '<p><r w:id=\"' || p_partkey || '\"><t>' || p_name || '</t></r><t>' || p_size || '</t></p>' AS v FROM part")
sql("scoped_markers", f"SELECT p_partkey, {V.scoped_marker('t', 'p_size', 'f')} AS v FROM (SELECT p_partkey, p_size, element_at(array('%1.', '•', '(%2)', NULL), cast(p_partkey % 4 + 1 AS int)) AS t, element_at(array('decimal', 'cardinalText', 'hex', 'ordinal'), cast(p_partkey % 4 + 1 AS int)) AS f FROM part)",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '(' || p_size || ')' ELSE p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END END AS v FROM part")
sql("marker_tokens", "SELECT p_partkey, " + formats.marker_token("element_at(array('%1.', '%1.%2) x', 'a):;', '', ' (b) c'), cast(p_partkey % 5 + 1 AS int))") + " AS v FROM part", "SELECT p_partkey, ['1', '1.2', 'a', '', '(b'][p_partkey % 5 + 1] AS v FROM part")
sql("level_metrics", f"SELECT p_partkey, {V.level_points('p_size * 10')} AS indent, round({V.spaced_width('10D', 'p_name', '0.5D')}, 6) AS width FROM part", "SELECT p_partkey, CASE WHEN p_size * 10 > 144 THEN p_size / 2.0::DOUBLE ELSE p_size * 10.0::DOUBLE END AS indent, 10 + 0.5::DOUBLE * length(p_name) AS width FROM part")
sql("text_valid", f"SELECT doc_id, {V.text_ok('text')} AS ok FROM documents", "SELECT doc_id, NOT regexp_matches(text, '[ \\t\\n]{10,}') AND length(text) > 0 AS ok FROM documents")
sql("html_valid", f"SELECT page_id, {V.balanced('html', '<', '>')} AS balanced, {V.balanced('html', '<ul', '</ul')} AS lists FROM pages", "SELECT page_id, len(string_split(html, '<')) = len(string_split(html, '>')) AS balanced, len(string_split(html, '<ul')) = len(string_split(html, '</ul')) AS lists FROM pages")
sql("json_valid", f"SELECT event_id, {V.json_ok('if(event_id % 3 = 0, concat(props, \"{\"), props)')} AS ok FROM events", "SELECT event_id, event_id % 3 <> 0 AND json_valid(props) AS ok FROM events")
sql("field_tokens", f"SELECT o_orderkey, {V.filled_tokens(chr(39) + 'Page [PAGE] of [NUMPAGES]' + chr(39), {'[PAGE]': 'o_orderkey', '[NUMPAGES]': 'o_custkey'})} AS v FROM orders", "SELECT o_orderkey, 'Page ' || o_orderkey || ' of ' || o_custkey AS v FROM orders")
sql("payload_resolve", f"SELECT event_id, get_json_object(j, '$.id') AS id, get_json_object(j, '$.list[0]') AS kind, get_json_object(j, '$.kept') AS kept FROM (SELECT event_id, {V.filled_tokens(chr(39) + '{\"id\": \"{{Id}}\", \"list\": [\"{{Type}}\", 1], \"kept\": \"{{No}}\"}' + chr(39), {'{{Id}}': 'event_id', '{{Type}}': 'event_type'})} AS j FROM events)",
    "SELECT event_id, event_id::VARCHAR AS id, event_type AS kind, '{{No}}' AS kept FROM events")
sql("tab_stops", f"SELECT p_partkey, array_join({V.kept_stops('array(p_size * 20, -p_size, p_partkey % 7)')}, ';') AS v FROM part", "SELECT p_partkey, (p_size * 20) || ';' || (p_partkey % 7) AS v FROM part WHERE p_size > 0")
sql("style_validity", f"SELECT p_partkey, {V.valid_style('s')} AS ok FROM (SELECT p_partkey, element_at(array(map('size', '0'), map('size', '12', 'color', 'FF00aa'), map('before', '-3'), map('color', 'nope'), map('left', cast(p_size AS string))), cast(p_partkey % 5 + 1 AS int)) AS s FROM part)", "SELECT p_partkey, p_partkey % 5 IN (1, 4) AS ok FROM part")

# --- styles, lists, templates, merges, text ---------------------------------------------------------------------------------------------


@query("style_cascade", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS a, p_brand AS b FROM part")
def style_cascade(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("a"), "p_type").alias("theme"), F.create_map(F.lit("b"), "p_brand", F.lit("a"), F.lit("")).alias("named"), F.expr("if(p_size % 2 = 0, map('a', p_name), cast(NULL AS map<string,string>))").alias("local"))
    cascade = own.select("p_partkey", S.cascaded("theme", "named", "local").alias("s"))
    return cascade.select("p_partkey", F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b"))



@query("deep_style_chains", "SELECT l_suppkey AS doc_id, i::VARCHAR AS style_id, i::INT AS depth, l_suppkey || '-0' AS root FROM (SELECT DISTINCT l_suppkey FROM lineitem), range(0, 60) t(i)")
def deep_style_chains(spark, d):
    """Every supplier is a document with the same 60 style ids, each based on the one before; the root's property is the document's own."""
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    styles = own.select("doc_id", F.col("i").cast("string").alias("style_id"), F.when(F.col("i") > 0, (F.col("i") - 1).cast("string")).alias("based_on"), F.when(F.col("i") == 0, F.create_map(F.lit("root"), F.concat("doc_id", F.lit("-0")))).otherwise(F.create_map(F.lit("own"), F.col("i").cast("string"))).alias("properties"))
    depth = S.chains(styles).groupBy("doc_id", "style_id").agg(F.max("depth").alias("depth"))
    return depth.join(S.resolved(styles), ["doc_id", "style_id"]).select("doc_id", "style_id", "depth", F.col("properties")["root"].alias("root"))


@query("continued_counters", "SELECT user_id AS doc_id, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY event_id) AS counter FROM (SELECT *, sum((event_id % 10 = 0)::INT) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)")
def continued_counters(spark, d):
    own = table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS seq", "event_type AS num_id", "0 AS level", "event_id % 10 = 0 AS restart")
    return E.continued(own, "restart").select("doc_id", "seq", F.col("counter").cast("long").alias("counter"))


@query("table_placeholders", """WITH p AS (SELECT doc_id, seq, CASE seq % 6 WHEN 1 THEN '{{ TABLE:Items }}' WHEN 4 THEN 'see {TABLE:Items} here' ELSE text END AS text FROM $PARA),
  c AS (SELECT doc_id, unnest([['Name', 'No'], ['a', '1'], ['b', '2']]) AS cells, unnest([1, 2, 3]) AS part FROM (SELECT DISTINCT doc_id FROM $PARA WHERE doc_id % 2 = 0))
  SELECT doc_id, seq, 0 AS part, 'paragraph' AS kind, md5(CASE WHEN doc_id % 2 = 0 AND seq % 6 = 4 THEN 'see  here' ELSE text END) AS v, false AS bold FROM p WHERE NOT (doc_id % 2 = 0 AND seq % 6 = 1)
  UNION ALL SELECT doc_id, seq, part, 'table_row', array_to_string(cells, ','), part = 1 FROM p JOIN c USING (doc_id) WHERE seq % 6 IN (1, 4)""")
def table_placeholders(spark, d):
    own = para(spark, d).withColumn("text", F.expr("CASE seq % 6 WHEN 1 THEN '{{ TABLE:Items }}' WHEN 4 THEN 'see {TABLE:Items} here' ELSE text END"))
    data = own.filter("doc_id % 2 = 0").select("doc_id").distinct().selectExpr("doc_id", "posexplode(array(array('Name', 'No'), array('a', '1'), array('b', '2'))) AS (row, cells)")
    found = P.table_rows(own, "TABLE:Items", data)
    return found.select("doc_id", "seq", "part", "kind", F.when(F.col("kind") == "paragraph", F.md5("text")).otherwise(F.array_join("cells", ",")).alias("v"), "bold")


@query("watermarks", "SELECT doc_id, 'DRAFT' AS text, 45 AS angle, 0 AS left_over FROM (SELECT DISTINCT doc_id FROM $PARA WHERE seq = 3)")
def watermarks(spark, d):
    rows, marks = P.watermarks(para(spark, d).withColumn("text", F.expr("if(seq = 3, concat('{{WATERMARK:State}}', text), text)")), "WATERMARK:State", "DRAFT")
    left = rows.filter(F.contains(F.col("text"), F.lit("WATERMARK"))).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    return marks.join(left, "doc_id", "left").select("doc_id", "text", "angle", F.coalesce("n", F.lit(0)).alias("left_over"))


@query("selective_merge", "SELECT n_nationkey, 't' AS side, ['body', 'headers', 'styles'][n_nationkey % 3 + 1] AS part FROM $NATION WHERE n_nationkey % 3 <> 1 UNION ALL SELECT n_nationkey, 's', ['body', 'headers', 'styles'][n_nationkey % 3 + 1] FROM $NATION WHERE n_nationkey % 3 < 2")
def selective_merge(spark, d):
    own = blocks(spark, d).selectExpr("n_nationkey", "element_at(array('body', 'headers', 'styles'), n_nationkey % 3 + 1) AS part")
    return M.selected(own.withColumn("side", F.lit("t")), own.withColumn("side", F.lit("s")), ("body", "headers"))


@query("section_merge", "SELECT n_regionkey AS doc_id, section, CASE WHEN section = 0 AND n_regionkey % 2 = 0 THEN 100 + n_regionkey ELSE 10 * section END AS width, 7 AS height FROM (SELECT DISTINCT n_regionkey FROM $NATION), (VALUES (0), (1)) t(section)")
def section_merge(spark, d):
    docs = blocks(spark, d).select(F.col("n_regionkey").alias("doc_id")).distinct()
    target = docs.selectExpr("doc_id", "explode(array(0, 1)) AS section").withColumns({"width": F.col("section") * 10, "height": F.lit(7)})
    source = docs.selectExpr("doc_id", "0 AS section", "if(doc_id % 2 = 0, 100 + doc_id, NULL) AS width", "cast(NULL AS int) AS height")
    return M.sections_merged(target, source, "width", "height")


@query("media_merge", "SELECT n_regionkey AS doc_id, 'rId' || n_nationkey AS rel_id, n_name AS target, 'rId' || n_nationkey AS new_id FROM $NATION WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_regionkey, 'rId' || n_nationkey, n_name, 'rId' || ((SELECT max(t.n_nationkey) FROM $NATION t WHERE t.n_nationkey % 2 = 0 AND t.n_regionkey = s.n_regionkey) + row_number() OVER (PARTITION BY n_regionkey ORDER BY 'rId' || n_nationkey)) FROM $NATION s WHERE n_nationkey % 2 = 1 AND n_nationkey > 5")
def media_merge(spark, d):
    own = blocks(spark, d).selectExpr("n_nationkey AS k", "n_regionkey AS doc_id", "concat('rId', n_nationkey) AS rel_id", "n_name AS target")
    return M.media_merged(own.filter("k % 2 = 0").drop("k"), own.filter("k % 2 = 1").drop("k"), own.filter("k > 5"))


MD = "SELECT doc_id, seq, CASE seq % 5 WHEN 0 THEN '## ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '1. ' || text ELSE text END AS line FROM $PARA"


@query("markdown_documents", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY seq), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n(#{{1,6}}\\s)', chr(10) || chr(10) || '\\1', 'g'), '\\n([*+-]\\s)', chr(10) || chr(10) || '\\1', 'g'), '\\n(\\d+\\.\\s)', chr(10) || chr(10) || '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS v FROM ({MD}) GROUP BY doc_id")
def markdown_documents(spark, d):
    own = para(spark, d).selectExpr("doc_id", "seq", "text", "if(seq % 5 = 0, 'heading', if(seq % 5 < 3, 'list_item', 'paragraph')) AS kind", "2 AS level", "if(seq % 5 = 1, 'bullet', 'number') AS form")
    return sink.markdown_documents(own).select("doc_id", F.md5("markdown").alias("v"))


@query("typed_fill", "SELECT o_orderkey, 'Pay ' || replace(replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ','), ' PLN', '') || ' PLN by ' || strftime(o_orderdate, '%d.%m.%Y') || ' for order ' || o_orderkey || '; {Open}' AS text FROM orders")
def typed_fill(spark, d):
    """The first pass puts a text in that holds a further placeholder."""
    own = table(spark, d, "orders").withColumn("text", F.lit("Pay {{ CURRENCY:Sum }} by {DATE:Due} for {{TEXT:What}}; {Open}"))
    return fill.texts(own, {"CURRENCY:Sum": "o_totalprice", "DATE:Due": "o_orderdate", "TEXT:What": "'order {No}'", "No": "o_orderkey"}).select("o_orderkey", "text")


@query("xml_mapped", "SELECT p_partkey, p_name AS name, p_size AS size, p_partkey::VARCHAR AS id FROM part")
def xml_mapped(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.expr("concat('<w:p xmlns:w=\"u\" w:id=\"', p_partkey, '\"><w:n>', p_name, '</w:n><w:s>', p_size, '</w:s></w:p>')").alias("xml"))
    return media.mapped(own, "xml", name="n", size="s:int", id="p@id").drop("xml")


@query("media_added", "SELECT p_size AS doc_id, md5(p_type) AS md5, min(p_name || p_partkey) AS path, 'other' AS type, CAST(octet_length(encode(p_type)) AS INT) AS size FROM part GROUP BY 1, 2, 4, 5")
def media_added(spark, d):
    own = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.concat("p_name", "p_partkey").alias("path"), F.col("p_type").cast("binary").alias("content"), "p_partkey")
    return media.added(own.filter("p_partkey % 2 = 0").drop("p_partkey"), own.filter("p_partkey % 2 = 1").drop("p_partkey")).select("doc_id", "md5", "path", "type", "size")


@query("style_themes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Lato' END AS font, '11' AS size FROM part")
def style_themes(spark, d):
    own = table(spark, d, "part").select("p_partkey", plugins.theme_source(lambda: {"font": "Lato", "size": "11"}).alias("theme"), F.expr("if(p_size % 2 = 0, map('font', p_name), map())").alias("local"))
    return own.select("p_partkey", S.cascaded("theme", "local").alias("s")).select("p_partkey", F.col("s")["font"].alias("font"), F.col("s")["size"].alias("size"))


@query("dispatched_layout", "SELECT doc_id, seq, CASE WHEN seq % 5 = 3 THEN 40.0::DOUBLE WHEN seq % 7 = 5 THEN NULL ELSE length(text) / 2.0::DOUBLE END AS h FROM $PARA")
def dispatched_layout(spark, d):
    engines = plugins.Dispatcher()
    engines.add(lambda kind: kind.startswith("para"), lambda kind: F.char_length("text") / 2.0)
    engines.add(lambda kind: kind in ("table", "cell"), lambda kind: F.lit(40.0))
    return E.with_kinds(para(spark, d)).select("doc_id", "seq", engines.column("kind", "paragraph", "table", "image").alias("h"))

# --- further rules ---------------------------------------------------------------------------------------------------------------------

sql("color_channels", f"SELECT p_partkey, c.r, c.g, c.b, {V.rgb_hex('p_size', '(p_partkey % 256)', '0')} AS h FROM (SELECT p_partkey, p_size, {V.rgb('t')} AS c FROM (SELECT p_partkey, p_size, element_at(array('#a1b', '00FF7f', '#12', 'red'), cast(p_partkey % 4 + 1 AS int)) AS t FROM part))",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 170 WHEN 1 THEN 0 END AS r, CASE p_partkey % 4 WHEN 0 THEN 17 WHEN 1 THEN 255 END AS g, CASE p_partkey % 4 WHEN 0 THEN 187 WHEN 1 THEN 127 END AS b, '#' || format('{:02x}', p_size) || format('{:02x}', p_partkey % 256) || '00' AS h FROM part")
sql("hsl_colors", f"SELECT p_partkey, c.r, c.g, c.b FROM (SELECT p_partkey, {V.hsl_rgb('(p_size * 7.2D)', '0.5D', '0.4D')} AS c FROM part)",
    "SELECT p_partkey, round(255 * (0.2::DOUBLE + CASE WHEN s < 1 OR s >= 5 THEN 0.4::DOUBLE WHEN s < 2 THEN 0.4::DOUBLE * (2 - s) WHEN s < 4 THEN 0 ELSE 0.4::DOUBLE * (s - 4) END))::INT AS r, round(255 * (0.2::DOUBLE + CASE WHEN s < 1 THEN 0.4::DOUBLE * s WHEN s < 3 THEN 0.4::DOUBLE WHEN s < 4 THEN 0.4::DOUBLE * (4 - s) ELSE 0 END))::INT AS g, round(255 * (0.2::DOUBLE + CASE WHEN s < 2 THEN 0 WHEN s < 3 THEN 0.4::DOUBLE * (s - 2) WHEN s < 5 THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * (6 - s) END))::INT AS b FROM (SELECT p_partkey, (p_size * 7.2::DOUBLE / 60) % 6 AS s FROM part)")
sql("rect_unions", f"SELECT p_partkey, u.x, u.y, u.w, u.h FROM (SELECT p_partkey, {V.united('a', 'b')} AS u FROM (SELECT p_partkey, named_struct('x', p_size, 'y', 5, 'w', 10, 'h', 10) AS a, named_struct('x', 20, 'y', p_partkey % 9, 'w', 4, 'h', 30) AS b FROM part))",
    "SELECT p_partkey, least(p_size, 20) AS x, least(5, p_partkey % 9) AS y, greatest(p_size + 10, 24) - least(p_size, 20) AS w, greatest(15, p_partkey % 9 + 30) - least(5, p_partkey % 9) AS h FROM part")
sql("numbers_or_texts", f"SELECT p_partkey, {V.number_or_text('if(p_size % 2 = 0, concat(p_size, \" 000,5\"), p_name)')} AS v FROM part", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '000.5' ELSE p_name END AS v FROM part")
FIELDS = "element_at(array('TOC \\\\o \"1-3\" \\\\h \\\\z', 'REF Mark \\\\h', 'PAGE \\\\* ROMAN', 'DATE \\\\@ \"dd MM\"', 'seq x \\\\# 0.0'), cast(event_id % 5 + 1 AS int))"
sql("field_parts", f"SELECT event_id, p.name, p.target, p.levels, p.picture, p.number_format, p.display, array_join(p.flags, '') AS flags FROM (SELECT event_id, {V.field_parts(FIELDS)} AS p FROM events)",
    "SELECT event_id, ['TOC', 'REF', 'PAGE', 'DATE', 'SEQ'][k] AS name, [NULL, 'Mark', NULL, NULL, 'x'][k] AS target, CASE WHEN k = 1 THEN '1-3' END AS levels, CASE WHEN k = 4 THEN 'dd MM' END AS picture, CASE WHEN k = 3 THEN 'ROMAN' END AS number_format, CASE WHEN k = 5 THEN '0.0' END AS display, ['hz', 'h', '', '', ''][k] AS flags FROM (SELECT event_id, event_id % 5 + 1 AS k FROM events)")
sql("page_tokens", f"SELECT event_id, {V.page_tokens(chr(39) + '[PAGE]/[NUMPAGES] [DATE] [TIME]' + chr(39), 'user_id', 'event_id', 'ts')} AS v FROM events", "SELECT event_id, user_id || '/' || event_id || ' ' || strftime(ts, '%d.%m.%Y %H:%M') AS v FROM events")
sql("text_paragraphs", f"SELECT p_partkey, {V.text_paragraph('p_name', 'k', '(p_size % 3 + 1)', 'if(p_size % 2 = 0, \"number\", \"bullet\")', 'p_size % 5 = 0', 'false', 200)} AS v FROM (SELECT *, element_at(array('heading', 'list_item', 'paragraph'), cast(p_partkey % 3 + 1 AS int)) AS k FROM part)",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN m || chr(10) || repeat('=', length(m)) WHEN 1 THEN m || chr(10) || repeat('-', length(m)) ELSE '### ' || m END WHEN 1 THEN repeat('  ', (p_size % 3 + 1)::INT) || CASE WHEN p_size % 2 = 0 THEN '1. ' ELSE '• ' END || m ELSE m END AS v FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN '**' || p_name || '**' ELSE p_name END AS m FROM part)")


@query("deep_styles", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Lato' END AS face, '11' AS size, p_brand AS color, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS raw FROM part")
def deep_styles(spark, d):
    base, over = "map('font', map('face', 'Lato', 'size', '11'))", "map('font', map('face', if(p_size % 2 = 0, p_name, '')), 'text', map('color', p_brand))"
    own = table(spark, d, "part").select("p_partkey", S.deep_merged(base, over).alias("s"), S.deep_merged(base, over, skip_empty=False).alias("r"))
    return own.select("p_partkey", F.col("s")["font"]["face"].alias("face"), F.col("s")["font"]["size"].alias("size"), F.col("s")["text"]["color"].alias("color"), F.col("r")["font"]["face"].alias("raw"))


@query("document_stats", f"SELECT doc_id, count(*) AS total, count_if(seq % 5 <> 3 AND seq % 7 <> 5)::BIGINT AS paragraphs, count_if(seq % 5 = 3)::BIGINT AS tables, 3::BIGINT AS pages, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS characters FROM {PARA_DUCK} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY doc_id, n_chars")
def document_stats(spark, d):
    told = table(spark, d, "documents").selectExpr("doc_id", "inline(array(named_struct('name', 'Pages', 'value', '3'), named_struct('name', 'Characters', 'value', if(doc_id % 2 = 0, cast(n_chars AS string), 'many'))))")
    return R.document_stats(E.with_kinds(para(spark, d)), told).select("doc_id", "total", "paragraphs", "tables", "pages", "characters")


@query("run_signatures", "SELECT user_id AS doc_id, event_type AS font, count(*) AS n, (row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)))::INT AS number FROM events GROUP BY 1, 2")
def run_signatures(spark, d):
    return R.run_signatures(table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS seq", "0 AS run", "event_type AS font"), "font")


@query("unique_ids", "SELECT n_regionkey AS doc_id, n_name, 'el' || (n_regionkey * 10 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)) AS id FROM $NATION")
def unique_ids(spark, d):
    taken = blocks(spark, d).select("n_regionkey").distinct().selectExpr("n_regionkey AS doc_id", "explode(array(concat('el', n_regionkey * 10), 'el2x', 'other99')) AS id")
    return R.unique_ids(blocks(spark, d).selectExpr("n_regionkey AS doc_id", "n_name"), taken, "el", "n_name")


@query("global_note_numbers", "SELECT user_id AS doc_id, event_type AS kind, event_id % 9 AS note_id, (row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type))::INT AS number FROM events GROUP BY 1, 2, 3")
def global_note_numbers(spark, d):
    return R.global_numbers(table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS seq", "event_type AS kind", "event_id % 9 AS note_id"))


@query("first_differences", "SELECT doc_id, seq FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM $PARA WHERE seq % 3 = 0) WHERE n <= 10")
def first_differences(spark, d):
    own = para(spark, d)
    return R.first_differences(own, own.withColumn("text", F.expr("if(seq % 3 = 0, concat(text, '!'), text)"))).select("doc_id", "seq")


@query("row_heights", "SELECT l_orderkey AS table_id, \"row\", h AS height, (sum(h) OVER (PARTITION BY l_orderkey ORDER BY \"row\")) - h AS y FROM (SELECT l_orderkey, l_linenumber % 4 AS \"row\", max(l_quantity) * 12.0::DOUBLE + 4 AS h FROM lineitem GROUP BY 1, 2)")
def row_heights(spark, d):
    return R.row_heights(table(spark, d, "lineitem").selectExpr("l_orderkey AS table_id", "l_linenumber % 4 AS row", "l_quantity AS lines"), 12.0, 2.0)


@query("html_updates", "SELECT doc_id, seq, md5(CASE WHEN seq % 2 = 0 OR doc_id % 2 = 0 THEN text ELSE text || '!' END) AS v FROM $PARA")
def html_updates(spark, d):
    own = para(spark, d)
    return E.updated(own, own.filter("doc_id % 2 = 1").withColumn("text", F.expr("if(seq % 2 = 0, text, concat(text, '!'))"))).select("doc_id", "seq", F.md5("text").alias("v"))


@query("layout_build", "SELECT n_regionkey AS doc_id, n_nationkey AS seq, CASE n_nationkey % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' ELSE 'body' END AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'center' END AS jc, CASE WHEN n_nationkey % 4 = 1 THEN 'decimal' END AS format FROM $NATION")
def layout_build(spark, d):
    own = blocks(spark, d).selectExpr("n_regionkey AS doc_id", "n_nationkey AS seq", "element_at(array('header1', 'footer2', 'document'), n_nationkey % 3 + 1) AS part", "if(n_nationkey % 2 = 0, 'H', 'N') AS style", "if(n_nationkey % 4 = 1, '7', NULL) AS num_id", "0 AS level")
    docs = own.select("doc_id").distinct()
    styles = docs.withColumns({"style_id": F.lit("H"), "properties": F.expr("map('jc', 'center')")})
    levels = docs.withColumns({"num_id": F.lit("7"), "level": F.lit(0), "format": F.lit("decimal"), "template": F.lit("%1.")})
    return E.built(own, styles, levels).select("doc_id", "seq", "place", F.col("properties")["jc"].alias("jc"), "format")


@query("replacement_counts", "SELECT doc_id, sum(CASE WHEN seq % 4 = 0 THEN 2 WHEN seq % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS n FROM $PARA GROUP BY doc_id")
def replacement_counts(spark, d):
    own = para(spark, d).withColumn("text", F.expr("CASE seq % 4 WHEN 0 THEN 'a {{TEXT:Xy}} {Xy} b' WHEN 1 THEN '{ Xy }' ELSE text END"))
    return P.replaced_counted(own, "TEXT:Xy", "v")[1]


@query("image_placeholders", "SELECT doc_id, seq, 0 AS part, 'paragraph' AS kind, NULL AS width, NULL AS height FROM $PARA UNION ALL SELECT doc_id, seq, 1, 'image', 400, 200 FROM $PARA WHERE seq = 1 AND doc_id % 2 = 0")
def image_placeholders(spark, d):
    own = para(spark, d).withColumn("text", F.expr("if(seq = 1, 'x {IMAGE:Logo}', text)"))
    images = own.filter("doc_id % 2 = 0").select("doc_id").distinct().selectExpr("doc_id", "'a.png' AS path", "cast(NULL AS int) AS width", "cast(NULL AS int) AS height", "800 AS own_width", "400 AS own_height")
    return P.image_rows(own, "IMAGE:Logo", images).select("doc_id", "seq", "part", "kind", "width", "height")


@query("text_tables", """WITH c AS (SELECT l_orderkey AS table_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS r, l_partkey::VARCHAR AS a, l_returnflag AS b FROM lineitem),
  w AS (SELECT table_id, max(length(a))::INT AS n FROM c GROUP BY 1), l AS (SELECT table_id, r, rpad(a, n, ' ') || ' | ' || b AS line FROM c JOIN w USING (table_id))
  SELECT table_id, min(line) FILTER (WHERE r = 1) || chr(10) || repeat('-', length(min(line) FILTER (WHERE r = 1))) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r > 1), '') AS text FROM l GROUP BY 1""")
def text_tables(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), place.alias("row"), F.array(F.col("l_partkey").cast("string"), "l_returnflag").alias("cells"))
    return sink.text_tables(own)


@query("csv_documents", "SELECT conv_id AS doc_id, 'Title,x' || chr(13) || chr(10) || string_agg(CASE WHEN turn % 2 = 0 THEN 'Paragraph,' || role ELSE 'Table ' || n || chr(13) || chr(10) || 'H,h' || chr(13) || chr(10) || role || ',' || turn END, chr(13) || chr(10) ORDER BY turn) AS csv FROM (SELECT *, sum(turn % 2) OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations) GROUP BY conv_id")
def csv_documents(spark, d):
    tables = "if(turn % 2 = 0, NULL, array(named_struct('is_header', false, 'cells', array(role, cast(turn AS string))), named_struct('is_header', true, 'cells', array('H', 'h'))))"
    return sink.csv_document(table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS seq", "role AS text", f"{tables} AS tables"), {"Title": "x"})


@query("flat_elements", "SELECT conv_id AS doc_id, count(*) AS n, count_if(turn % 2 = 0)::BIGINT AS styled, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def flat_elements(spark, d):
    own = table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS seq", "'paragraph' AS kind", "role AS text", "if(turn % 2 = 0, 'Quote', NULL) AS style", "named_struct('x', turn, 'y', 0) AS position")
    read = sink.flat_elements(own, "style", "position").select("doc_id", F.from_json("json", "elements array<struct<type:string,id:string,text:string,style:string,position:struct<x:int,y:int>>>").alias("j"))
    e = F.col("j.elements")
    return read.select("doc_id", F.size(e).cast("long").alias("n"), F.size(F.filter(e, lambda x: x["style"] == "Quote")).cast("long").alias("styled"), F.array_join(e["text"], ",").alias("roles"))
