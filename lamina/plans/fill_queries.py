"""Templates filled as a whole: every order is a document with its lines as a table and a list."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import fill
from lamina.plans.base import query, table

TEMPLATE = ("Order {No} of {{ DATE:Day }}: {Line}", "{{START_Even}}", "of {DATE:Day}, {Unknown}", "{{ END_Even }}", "{{TABLE:Items}}", "Parts {LIST:Parts} end", "{NOTE:x} [{No}]{ FORMULA:F }")
SUM_DUCK = "replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ',') || ' PLN'"


def orders(spark, d):
    """(doc_id, o_totalprice, o_orderdate, cells with a header, parts) of each order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("{No}/"), F.col("l_partkey").cast("string"))).alias("cells"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderdate").join(lines, "doc_id", "left")
    header = F.array(F.array(F.lit("No"), F.lit("Part")))
    return own.select("doc_id", "o_totalprice", "o_orderdate", F.concat(header, F.coalesce(F.col("lines.cells"), F.array().cast("array<array<string>>"))).alias("cells"), F.transform("lines", lambda x: x["l_partkey"].cast("string")).alias("parts"))


@query("template_fill_blocks", f"""WITH o AS (SELECT o_orderkey AS doc_id, {SUM_DUCK} AS s, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders),
l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_linenumber::VARCHAR AS a, l_orderkey || '/' || l_partkey AS b, l_partkey::VARCHAR AS p FROM lineitem),
r AS (SELECT doc_id, 0 AS seq, 0 AS part, 'paragraph' AS kind, 'Order ' || doc_id || ' of ' || day || ': pay ' || s AS v FROM o
UNION ALL SELECT doc_id, k, 0, 'paragraph', CASE k WHEN 2 THEN 'of ' || day || ', {{Unknown}}' ELSE '' END FROM o, (VALUES (1), (2), (3)) x(k) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 4, 0, 'table_row', 'No|Part' FROM o WHERE doc_id IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 4, i, 'table_row', a || '|' || b FROM l
UNION ALL SELECT doc_id, 4, 0, 'paragraph', '{{{{TABLE:Items}}}}' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM l)
UNION ALL SELECT doc_id, 5, 0, 'paragraph', CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN 'Parts  end' ELSE 'Parts {{LIST:Parts}} end' END FROM o UNION ALL SELECT doc_id, 5, i, 'list_item', p FROM l
UNION ALL SELECT doc_id, 6, 0, 'paragraph', '{{NOTE:x}} [' || doc_id || '](Σ x)' FROM o)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) - 1 AS seq, kind, md5(v) AS v FROM r""")
def template_fill_blocks(spark, d):
    """Texts that bring further placeholders, a section for even orders, a table and a list, and names without a value."""
    data = orders(spark, d)
    rows = data.select("doc_id", F.posexplode(F.array(*map(F.lit, TEMPLATE))).alias("seq", "text")).withColumn("kind", F.lit("paragraph"))
    values = {"No": "doc_id", "DATE:Day": "o_orderdate", "CURRENCY:Sum": "o_totalprice", "Line": "'pay {CURRENCY:Sum}'", "FORMULA:F": r"'\\sum x'"}
    out = fill.filled(rows, data, values, {"TABLE:Items": fill.table_block("cells"), "LIST:Parts": fill.list_block("parts")}, {"Even": "doc_id % 2 = 0"})
    return out.select("doc_id", "seq", "kind", F.md5(F.coalesce(F.array_join("cells", "|"), "text")).alias("v"))


@query("fill_passes", "SELECT p_partkey, CASE WHEN p_size % 7 < 5 THEN 'end' || repeat('.', (p_size % 7)::INT) ELSE '{Deep' || (p_size % 7 - 5) || '}' || repeat('.', 5) END AS text FROM part")
def fill_passes(spark, d):
    """A chain of values that lead to one another: five passes reach the end of the shorter ones, and longer ones stop where they are."""
    own = table(spark, d, "part").select("p_partkey", F.expr("concat('{Deep', p_size % 7, '}')").alias("text"))
    return fill.texts(own, {"Deep0": "'end'"} | {f"Deep{k}": f"'{{Deep{k - 1}}}.'" for k in range(1, 7)})
