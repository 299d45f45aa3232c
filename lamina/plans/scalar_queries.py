"""Scalar rules over the tables: strings, numbers, dates, counters, units, colours, fields, media."""

from __future__ import annotations

from lamina.functions import formats as F
from lamina.functions import text as T
from lamina.plans.base import sql

TPL = "concat('Dear {{ TEXT:Name }}, pay {CURRENCY:Sum} by {{DATE:Due}} ({', o_orderpriority, '})')"
SP = "'[\\x20\\x09-\\x0D]+'"

sql("placeholder_inventory", f"SELECT name, type, count(*) AS cnt FROM (SELECT name, {T.placeholder_type('name')} AS type FROM (SELECT explode({T.placeholder_names(TPL)}) AS name FROM orders)) GROUP BY name, type",
    r"SELECT name, CASE upper(split_part(name, ':', 1)) WHEN 'CURRENCY' THEN 'currency' WHEN 'DATE' THEN 'date' ELSE 'text' END AS type, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all('Dear {{ TEXT:Name }}, pay {CURRENCY:Sum} by {{DATE:Due}} ({' || o_orderpriority || '})', '(\{\{|\{)\s*([^{}]+?)\s*(\}\}|\})', 2)) AS name FROM orders) GROUP BY 1, 2")
sql("placeholder_names_sorted", f"SELECT o_orderkey, array_join({T.sorted_names(TPL)}, '|') AS names FROM orders",
    "SELECT o_orderkey, array_to_string(list_sort(['TEXT:Name', 'CURRENCY:Sum', 'DATE:Due', o_orderpriority]), '|') AS names FROM orders")
sql("inline_marks", f"SELECT p_partkey, {T.inline_markup('p_name', 'p_partkey % 2 = 0', 'p_partkey % 3 = 0', 'p_partkey % 5 = 0', 'p_partkey % 7 = 0', 'p_partkey % 11 = 0')} AS v FROM part",
    "SELECT p_partkey, c || s || u || i || b || p_name || b || i || u || s || c AS v FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '**' ELSE '' END AS b, CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '' END AS i, CASE WHEN p_partkey % 5 = 0 THEN '_' ELSE '' END AS u, CASE WHEN p_partkey % 7 = 0 THEN '~~' ELSE '' END AS s, CASE WHEN p_partkey % 11 = 0 THEN '`' ELSE '' END AS c FROM part)")
sql("placeholder_keys", f"SELECT o_orderpriority, count(*) AS n, max({T.placeholder_key('concat(\"NUM:\", o_orderpriority)')}) AS k, max(size({T.spellings('o_orderpriority')})) AS forms FROM orders GROUP BY 1",
    "SELECT o_orderpriority, count(*) AS n, max(o_orderpriority) AS k, 6 AS forms FROM orders GROUP BY 1")
sql("currency_format", f"SELECT o_orderkey, {T.currency('o_totalprice')} AS v FROM orders", "SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ','), ' PLN', '') || ' PLN' AS v FROM orders")
sql("number_format", f"SELECT l_orderkey, l_linenumber, {T.number('l_quantity')} AS q, {T.number('l_extendedprice')} AS p FROM lineitem",
    "SELECT l_orderkey, l_linenumber, replace(format('{:,d}', l_quantity::BIGINT), ',', ' ') AS q, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN replace(format('{:,d}', l_extendedprice::BIGINT), ',', ' ') ELSE replace(replace(format('{:,.2f}', l_extendedprice), ',', ' '), '.', ',') END AS p FROM lineitem")
sql("percent_format", f"SELECT l_orderkey, l_linenumber, {T.percent('l_discount * 100')} AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, format('{:.1f}', l_discount * 100) || '%' AS v FROM lineitem")
sql("parsed_numbers", f"SELECT p_partkey, {T.parsed_number('concat(p_size, \" 000,5\")')} AS v, {T.parsed_number('p_name')} AS bad FROM part", "SELECT p_partkey, try_cast(p_size || '000.5' AS DOUBLE) AS v, try_cast(replace(replace(p_name, ' ', ''), ',', '.') AS DOUBLE) AS bad FROM part")
sql("date_formats", f"SELECT event_id, {T.date('ts')} AS d, {T.date('ts', 'time')} AS t, {T.date('ts', 'datetime')} AS dt, {T.date_text('event_type')} AS kept FROM events", "SELECT event_id, strftime(ts, '%d.%m.%Y') AS d, strftime(ts, '%H:%M') AS t, strftime(ts, '%d.%m.%Y %H:%M') AS dt, event_type AS kept FROM events")
sql("phone_format", f"SELECT c_custkey, {T.phone('cast(500000000 + c_custkey AS string)')} AS a, {T.phone('concat(\"+48\", 600000000 + c_custkey)')} AS b, {T.phone('c_name')} AS c FROM customer",
    "SELECT c_custkey, '+48 ' || left(x, 3) || ' ' || substr(x, 4, 3) || ' ' || substr(x, 7) AS a, '+48 ' || left(y, 3) || ' ' || substr(y, 4, 3) || ' ' || substr(y, 7) AS b, c_name AS c FROM (SELECT *, (500000000 + c_custkey)::VARCHAR AS x, (600000000 + c_custkey)::VARCHAR AS y FROM customer)")
sql("boolean_format", f"SELECT event_id, {T.boolean('if(event_id % 3 = 0, \"YES\", event_type)')} AS v FROM events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Tak' ELSE 'Nie' END AS v FROM events")
sql("email_format", f"SELECT c_custkey, {T.email('concat(\" c\", c_custkey, \"@x.org \")')} AS a, {T.email('concat(c_name, \"@x\")')} AS b FROM customer", "SELECT c_custkey, 'c' || c_custkey || '@x.org' AS a, c_name || '@x' AS b FROM customer")
sql("hyperlink_label", f"SELECT page_id, {T.hyperlink('nullif(url, \"\")', 'url')} AS v FROM pages", "SELECT page_id, url || ' (' || url || ')' AS v FROM pages")
sql("crossref_labels", f"SELECT p_partkey, {T.crossref('element_at(array(\"heading\", \"figure\", \"table\", \"equation\", \"x\"), cast(p_partkey % 5 + 1 AS int))', 'cast(p_size AS string)')} AS v FROM part",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Rozdział ' || p_size WHEN 1 THEN 'Rysunek ' || p_size WHEN 2 THEN 'Tabela ' || p_size WHEN 3 THEN 'Równanie (' || p_size || ')' ELSE 'Odwołanie ' || p_size END AS v FROM part")
sql("note_texts", f"SELECT p_partkey, {T.footnote('if(p_size % 2 = 0, cast(p_size AS string), null)', 'p_name')} AS f, {T.endnote('if(p_size % 2 = 0, \"i\", \"\")', 'p_name')} AS e FROM part",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '. ' || p_name ELSE '* ' || p_name END AS f, CASE WHEN p_size % 2 = 0 THEN 'i. ' || p_name ELSE '[' || p_name || ']' END AS e FROM part")
sql("formula_text", r"SELECT p_partkey, " + T.formula(r"concat('\\sum ', p_name, ' \\int')") + " AS v FROM part", "SELECT p_partkey, '(Σ ' || p_name || ' ∫)' AS v FROM part")
sql("space_collapse", f"SELECT doc_id, md5({T.collapse_spaces('text')}) AS v FROM documents", "SELECT doc_id, md5(regexp_replace(text, ' +', ' ', 'g')) AS v FROM documents")
sql("html_escape", f"SELECT page_id, md5({T.escape_html('html')}) AS v FROM pages", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS v FROM pages")
sql("ligature_counts", f"SELECT doc_id, size(l) AS n, size(filter(l, x -> x.form = 'ff')) AS ff, size(filter(l, x -> x.form = 'ft')) AS ft FROM (SELECT doc_id, {T.ligatures('text')} AS l FROM documents)",
    "SELECT doc_id, CAST(f.fi + f.fl + f.ff + f.ffi + f.ffl + f.ft AS INT) AS n, CAST(f.ff AS INT) AS ff, CAST(f.ft AS INT) AS ft FROM (SELECT doc_id, struct_pack(fi := len(string_split(text, 'fi')) - 1, fl := len(string_split(text, 'fl')) - 1, ff := len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'ff')), ffi := len(string_split(text, 'ffi')) - 1, ffl := len(string_split(text, 'ffl')) - 1, ft := len(string_split(text, 'ft')) - 1) AS f FROM documents)")
sql("heading_levels", f"SELECT p_partkey, {T.heading_level('concat(\"Heading \", p_size % 9)')} AS level, {T.heading_level('p_name')} AS none FROM part", "SELECT p_partkey, CAST(p_size % 9 AS INT) AS level, CAST(NULL AS INT) AS none FROM part")
sql("font_names", f"SELECT p_partkey, {T.font_name('concat(\"times NEW \", p_brand)')} AS v FROM part", "SELECT p_partkey, 'Times new ' || upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS v FROM part WHERE true")
sql("heading_text", f"SELECT n_nationkey, {T.heading('n_name', '(n_nationkey % 4 + 1)')} AS t, {T.markdown_heading('n_name', '(n_nationkey % 8 + 1)')} AS m FROM $NATION",
    "SELECT n_nationkey, CASE n_nationkey % 4 + 1 WHEN 1 THEN n_name || chr(10) || repeat('=', length(n_name)) WHEN 2 THEN n_name || chr(10) || repeat('-', length(n_name)) ELSE repeat('#', n_nationkey % 4 + 1) || ' ' || n_name END AS t, repeat('#', least(n_nationkey % 8 + 1, 6)) || ' ' || n_name AS m FROM $NATION")
sql("list_markers", f"SELECT n_nationkey, {T.list_marker('if(n_nationkey % 2 = 0, \"number\", \"bullet\")', 'n_nationkey % 3')} AS v, {T.inline_markup('n_name', 'n_nationkey % 2 = 0', 'n_nationkey % 3 = 0', 'n_nationkey % 5 = 0')} AS m FROM $NATION",
    "SELECT n_nationkey, repeat('  ', n_nationkey % 3) || CASE WHEN n_nationkey % 2 = 0 THEN '1.' ELSE '•' END AS v, u || i || b || n_name || b || i || u AS m FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN '**' ELSE '' END AS b, CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE '' END AS i, CASE WHEN n_nationkey % 5 = 0 THEN '_' ELSE '' END AS u FROM $NATION)")
sql("xml_similarity", f"SELECT a.n_nationkey, round({T.similarity('a.n_name', 'b.n_name')}, 9) AS s FROM $NATION a JOIN $NATION b ON b.n_nationkey = a.n_nationkey + 1",
    "SELECT a.n_nationkey, round(CASE WHEN a.n_name = b.n_name THEN 1.0 ELSE len(list_filter(range(1, least(length(a.n_name), length(b.n_name)) + 1), lambda i: substr(a.n_name, i, 1) = substr(b.n_name, i, 1)))::DOUBLE / greatest(length(a.n_name), length(b.n_name)) END, 9) AS s FROM $NATION a JOIN $NATION b ON b.n_nationkey = a.n_nationkey + 1")
N = "cast(p_partkey % 4200 AS int)"
ROMAN = "list_aggregate(list_transform([[1000,1],[100,2],[10,3],[1,4]], lambda d: ['','M','MM','MMM','','','','','','','','C','CC','CCC','CD','D','DC','DCC','DCCC','CM','','X','XX','XXX','XL','L','LX','LXX','LXXX','XC','','I','II','III','IV','V','VI','VII','VIII','IX'][((d[2] - 1) * 10 + (n // d[1]) % 10 + 1)::INT]), 'string_agg', '')"
sql("roman_counters", f"SELECT p_partkey, {F.roman(N)} AS v FROM part", f"SELECT p_partkey, CASE WHEN n <= 0 THEN '' WHEN n > 3999 THEN n::VARCHAR ELSE {ROMAN} END AS v FROM (SELECT *, (p_partkey % 4200)::INT AS n FROM part)")
sql("letter_counters", f"SELECT p_partkey, {F.letters('cast(p_partkey % 800 AS int)')} AS v FROM part",
    "SELECT p_partkey, CASE WHEN n <= 0 THEN '' WHEN n <= 26 THEN chr(96 + n) WHEN n <= 702 THEN chr(97 + (n - 27) // 26) || chr(97 + (n - 27) % 26) ELSE chr(97 + (n - 703) // 676) || chr(97 + ((n - 703) // 26) % 26) || chr(97 + (n - 703) % 26) END AS v FROM (SELECT *, (p_partkey % 800)::INT AS n FROM part)")
sql("counter_formats", f"SELECT p_partkey, {F.ordinal('p_size')} AS o, {F.cardinal('p_size')} AS c, {F.korean('p_size')} AS k, {F.chinese('p_size')} AS z, {F.counter('p_size', chr(39) + 'hex' + chr(39))} AS h, {F.counter('p_size', chr(39) + 'binary' + chr(39))} AS b FROM part",
    "SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS o, coalesce(map([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,30,40,50], ['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty','thirty','forty','fifty'])[p_size], p_size::VARCHAR) AS c, CASE WHEN p_size < 10 THEN substr('일이삼사오육칠팔구', p_size, 1) ELSE CASE WHEN p_size >= 20 THEN substr('일이삼사오육칠팔구', p_size // 10, 1) ELSE '' END || '십' || CASE WHEN p_size % 10 > 0 THEN substr('일이삼사오육칠팔구', p_size % 10, 1) ELSE '' END END AS k, CASE WHEN p_size < 10 THEN substr('一二三四五六七八九', p_size, 1) ELSE p_size::VARCHAR END AS z, format('{:x}', p_size) AS h, format('{:b}', p_size) AS b FROM part")
sql("marker_text", f"SELECT p_partkey, {F.marker('if(p_size % 3 = 0, \"%1.%2)\", if(p_size % 3 = 1, \"\", \"§ %1\"))', 'p_size', 'if(p_size % 2 = 0, \"decimal\", \"ordinal\")')} AS v FROM part",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN c || '.' || c || ')' WHEN 1 THEN c || '.' ELSE '§ ' || c END AS v FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END END AS c FROM part)")
sql("unit_conversion", f"SELECT p_partkey, round({F.convert('p_size', 'pt', 'mm')}, 9) AS mm, round({F.convert('p_size', 'px', 'pt')}, 9) AS pt, round({F.convert('p_size', 'twip', 'emu')}, 6) AS emu, {F.points('p_size', 'twip')} AS tw FROM part",
    "SELECT p_partkey, round(p_size / 2.834645669::DOUBLE, 9) AS mm, round(p_size * 25.4::DOUBLE / 96 * 2.834645669::DOUBLE, 9) AS pt, round(p_size * 0.0176389::DOUBLE / 0.000027778::DOUBLE, 6) AS emu, p_size / 20.0::DOUBLE AS tw FROM part")
sql("html_font_sizes", f"SELECT p_partkey, {F.html_font_size('concat(p_size, \"px\")')} AS px, {F.html_font_size('concat(p_size, \"em\")')} AS em, {F.html_font_size('concat(p_size, \".5pt\")')} AS pt FROM part",
    "SELECT p_partkey, CAST(CAST(floor(p_size * 1.5) AS INT) AS VARCHAR) AS px, CAST(p_size * 24 AS VARCHAR) AS em, CAST(p_size * 2 + 1 AS VARCHAR) AS pt FROM part")
sql("spacing_rounding", f"SELECT p_partkey, {F.rounded_spacing('p_size * 10')} AS v FROM part", "SELECT p_partkey, nullif(greatest(CAST(round_even(p_size * 10 / 120.0, 0) AS INT) * 120, 0), 0) AS v FROM part")
sql("html_colors", f"SELECT p_partkey, {F.html_color('element_at(array(\"#a1b\", \"#00ff7f\", \"Orange\", concat(\"rgb(\", p_size, \", 0, 255)\"), \"nope\"), cast(p_partkey % 5 + 1 AS int))')} AS v, {F.hex_color('concat(\"#ab\", lpad(p_size, 4, \"0\"))')} AS h FROM part",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AA11BB' WHEN 1 THEN '00FF7F' WHEN 2 THEN 'FFA500' WHEN 3 THEN upper(format('{:02x}', p_size)) || '00FF' END AS v, 'AB' || lpad(p_size::VARCHAR, 4, '0') AS h FROM part")
sql("color_hsl", f"SELECT p_partkey, round(c.h, 6) AS h, round(c.s, 6) AS s, round(c.l, 6) AS l, r FROM (SELECT p_partkey, {F.hsl('p_size', '(p_partkey % 256)', '128')} AS c, {F.channel('lpad(hex(p_size), 6, \"0\")', 2)} AS r FROM part)",
    "SELECT p_partkey, round(CASE WHEN d = 0 THEN 0 WHEN mx = r THEN 60 * (((g - b) / d) - 6 * floor(((g - b) / d) / 6)) WHEN mx = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END, 6) AS h, round(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * ((mx + mn) / 2) - 1)) END, 6) AS s, round((mx + mn) / 2, 6) AS l, p_size AS r FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, greatest(r, g, b) - least(r, g, b) AS d FROM (SELECT p_partkey, p_size, p_size / 255.0::DOUBLE AS r, (p_partkey % 256) / 255.0::DOUBLE AS g, 128 / 255.0::DOUBLE AS b FROM part))")
sql("field_types", f"SELECT event_id, {F.field_type('f')} AS t, {F.field_date_picture('f')} AS p FROM (SELECT event_id, element_at(array(' page ', 'PAGEREF x', 'DATE \\\\\\\\@ \"dd.MM.yyyy\"', 'toc', 'seq'), cast(event_id % 5 + 1 AS int)) AS f FROM events)",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'PAGE' WHEN 2 THEN 'DATE' WHEN 3 THEN 'TOC' ELSE 'unknown' END AS t, CASE WHEN event_id % 5 = 2 THEN 'dd.MM.yyyy' END AS p FROM events")
sql("media_sniff", f"SELECT p_partkey, {F.sniff('b')} AS f, {F.media_class('b')} AS c, md5(b) AS m, octet_length(b) AS n FROM (SELECT p_partkey, concat(element_at(array(X'89504E470D0A', X'FFD8FFE0', X'474946383961', X'25504446', X'504B0304'), cast(p_partkey % 5 + 1 AS int)), cast(p_name AS binary)) AS b FROM part)",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' END AS f, CASE WHEN p_partkey % 5 < 3 THEN 'image' WHEN p_partkey % 5 = 3 THEN 'pdf' ELSE 'archive' END AS c, md5(b) AS m, CAST(octet_length(b) AS INT) AS n FROM (SELECT p_partkey, unhex(['89504E470D0A', 'FFD8FFE0', '474946383961', '25504446', '504B0304'][p_partkey % 5 + 1]) || encode(p_name) AS b FROM part)")
sql("id_validity", f"SELECT c_custkey, {F.valid_id('replace(c_name, \"#\", \"_\")')} AS a, {F.valid_id('concat(c_name, \" x\")')} AS b FROM customer", "SELECT c_custkey, regexp_full_match(replace(c_name, '#', '_'), '[A-Za-z0-9_-]{1,100}') AS a, false AS b FROM customer")
sql("rect_intersections", f"SELECT a.p_partkey, {F.intersects('a.r', 'b.r')} AS hit, least(a.r.x, b.r.x) AS left_x FROM (SELECT p_partkey, named_struct('x', p_size, 'y', p_size * 2, 'w', 10, 'h', 10) AS r FROM part) a JOIN (SELECT p_partkey, named_struct('x', p_size, 'y', p_size * 2, 'w', 10, 'h', 10) AS r FROM part) b ON b.p_partkey = a.p_partkey + 1",
    "SELECT a.p_partkey, abs(a.p_size - b.p_size) <= 10 AND abs(a.p_size * 2 - b.p_size * 2) <= 10 AS hit, least(a.p_size, b.p_size) AS left_x FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
sql("text_metrics", f"SELECT p_partkey, round({F.text_width('p_name', 'p_size')}, 6) AS w, {F.aligned_x('10D', '400D', 'cast(length(p_name) AS double)', 'if(p_size % 2 = 0, \"center\", \"right\")')} AS x, {F.table_width('if(p_size % 2 = 0, \"pct\", \"dxa\")', 'p_size * 100', '450D')} AS tw FROM part",
    "SELECT p_partkey, round(length(p_name) * 0.6::DOUBLE * p_size, 6) AS w, CASE WHEN p_size % 2 = 0 THEN 10 + (400 - length(p_name)::DOUBLE) / 2 ELSE 10 + 400 - length(p_name)::DOUBLE END AS x, CASE WHEN p_size % 2 = 0 THEN least(p_size * 100 / 5000.0::DOUBLE, 1) * 450 ELSE p_size * 100 / 20.0::DOUBLE END AS tw FROM part")
sql("event_payloads", "SELECT event_id, get_json_object(props, '$.k') AS k, to_json(named_struct('id', event_id, 'type', event_type)) AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS j FROM events")