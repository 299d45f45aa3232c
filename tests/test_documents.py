"""Edge cases of the operators on tables, layout, templates, merges and checks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lamina.operators import checks, layout, merging, tables, templates
from lamina.plugins import Hooks, Registry
from lamina.sinks import text as sink


def test_conditional_sections(spark):
    texts = ["a", "{{START_X}}", "in", "{START_X}", "{ END_X }", "b", "{{ END_X}}", "{{START_X }}", "open"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "{{END_X}}"), (2, 1, None)], "doc_id long, seq int, text string")
    hidden = sorted((r.doc_id, r.seq) for r in templates.conditional(rows, "X", show=False).collect())
    assert hidden == [(1, 0), (1, 5), (1, 6), (1, 7), (1, 8), (2, 0), (2, 1)]
    shown = {(r.doc_id, r.seq): r.text for r in templates.conditional(rows, "X", show=True).collect()}
    assert len(shown) == len(texts) + 2 and shown[1, 1] == "" and shown[1, 2] == "in" and shown[2, 1] is None


def run_safe(runs: list[str], placeholder: str, value: str) -> list[str]:
    at = "".join(runs).find(placeholder)
    if at < 0:
        return runs
    end, pos, out, first = at + len(placeholder), 0, [], None
    for r in runs:
        start, stop = pos, pos + len(r)
        pos = stop
        if start >= end or stop <= at:
            out.append(r)
        elif first is None:
            first = len(out)
            out.append(r[: at - start] + value + (r[end - start :] if stop >= end else ""))
        else:
            out.append("")
            if stop >= end:
                out[first] += r[end - start :]
    return out


def test_run_safe_replacement(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(60):
        whole = "".join(rng.choice(["{K}", "x", "{", "K}", "yy"]) for _ in range(rng.randint(0, 6)))
        cuts = sorted(rng.randint(0, len(whole)) for _ in range(3))
        cases.append([whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)])
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, runs array<string>")
    found = {r.id: r.runs for r in templates.replaced_in_runs(rows, "runs", "{K}", F.lit("<v>")).collect()}
    assert found == {i: run_safe(c, "{K}", "<v>") for i, c in enumerate(cases)}


def test_rewound_counters(spark):
    rng = random.Random(9)
    steps = [(k, i, rng.choice((1, -1))) for k in range(5) for i in range(30)]
    rows = templates.rewound_counters(spark.createDataFrame(steps, "k int, i int, s int"), "k", "i", F.col("s"), start=4).collect()
    value, expected = {}, {}
    for k, i, s in steps:
        value[k] = expected[k, i] = max(value.get(k, 3) + s, 3)
    assert {(r.k, r.i): r.counter for r in rows} == expected


def breaks(total, start, line, available, top, bottom, keep, least=2):
    height = lambda a, b: (b - a) * line + (top if a == 0 else 0) + (bottom if b == total else 0)
    if start >= total or height(start, total) <= available + 1e-6:
        return total
    if keep and start == 0:
        return None
    end = start
    while end < total and height(start, end + 1) <= available + 1e-6:
        end += 1
    here, over = end - start, total - end
    if here <= 0:
        return start
    here -= max(least - over, 0)
    return start + here if here >= least else start


def test_paragraph_breaks(spark):
    cases = [(t, s, 12.0, float(a), 4.0, 2.0, k) for t in (0, 1, 2, 3, 5, 9) for s in (0, 1, 4) for a in (0, 11, 16, 28, 40, 52, 64, 200) for k in (False, True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, t int, s int, line double, a double, top double, bottom double, k boolean")
    found = {r.id: r.x for r in rows.select("id", F.expr(layout.paragraph_break("t", "s", "line", "a", "top", "bottom", "k")).alias("x")).collect()}
    assert found == {i: breaks(*c) for i, c in enumerate(cases)}


def test_pages_and_headers(spark):
    positions = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 1)], "doc_id long, position int")
    ends = spark.createDataFrame([(1, 10, 2), (3, 1, 9)], "doc_id long, position int, page_number int")
    assert {(r.doc_id, r.position): r.page for r in layout.page_of(positions, ends).collect()} == {(1, 5): 2, (1, 10): 2, (1, 11): 1, (2, 1): 1}
    pages = spark.createDataFrame([(1, {"first": "", "default": "d"}), (2, {"even": "e"}), (3, {"even": "e"}), (4, None)], "page int, v map<string,string>")
    assert [r.x for r in pages.orderBy("page").select(layout.variant("page", "v").alias("x")).collect()] == ["d", "e", None, None]


def test_tables_without_rows_or_cells(spark):
    rows = spark.createDataFrame([(1, 1, [], True), (2, 1, ["", " "], False), (2, 2, ["a|b", "c"], False)], "doc_id long, row int, cells array<string>, is_header boolean")
    found = {r.doc_id: (r.filled, r.empty, r.text_length, r.has_header, r.mean_length) for r in tables.content(rows).collect()}
    assert found == {1: (0, 0, 0, True, 0.0), 2: (2, 2, 4, False, 1.0)}
    one = tables.gathered(rows.filter("doc_id = 2"))
    assert one.select(tables.markdown("simple").alias("x")).first().x == "     \n".replace("     ", "   ") + "a|b  c\n"
    assert one.select(tables.cell(1, 1).alias("a"), tables.cell(5, 0).alias("b"), tables.cell(0, 9).alias("c")).first() == ("c", None, None)
    assert tables.content(rows.limit(0)).count() == 0


def test_merges_and_checks_of_little(spark):
    rows = spark.createDataFrame([(1, 7, 0, "paragraph", "x"), (1, 8, 0, "paragraph", "y"), (2, 9, 0, "table", "z")], "g int, doc_id long, seq int, kind string, text string")
    found = [(r.g, r.seq, r.kind) for r in merging.merged_in_order(rows, "g").orderBy("g", "seq").collect()]
    assert found == [(1, 0, "paragraph"), (1, 1, "page_break"), (1, 2, "paragraph"), (2, 0, "table")]
    styles = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (1, "d", "gone"), (1, "e", None), (2, "a", None)], "doc_id long, style_id string, based_on string")
    assert {(r.doc_id, r.style_id): (r.depth, r.cyclic) for r in merging.cycles(styles).collect()} == {(1, "a"): (1, True), (1, "b"): (1, True), (1, "c"): (2, True), (1, "d"): (0, False), (1, "e"): (0, False), (2, "a"): (0, False)}
    blocks = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, page int")
    issues = spark.createDataFrame([(1, "error")], "doc_id long, level string")
    assert {r.doc_id: (r.valid, r.errors, r.pages) for r in checks.summary(blocks, issues).collect()} == {1: (False, 1, 2), 2: (True, 0, 1)}
    a = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (2, 0, "")], "doc_id long, seq int, text string")
    same = {r.doc_id: (r.lost, r.text_lost, r.lost_percent, r.equal_places) for r in checks.compared(a, a.filter("seq = 0")).collect()}
    assert same == {1: (1, 1, 33.33, 1), 2: (0, 0, 0.0, 1)}


def test_text_sinks(spark):
    rows = spark.createDataFrame([(1, 0, "paragraph", 'a "b", c'), (1, 1, "image", "i"), (1, 2, "paragraph", " "), (1, 3, "table", "t")], "doc_id long, seq int, kind string, text string")
    assert sink.csv_stream(rows.withColumn("cells", F.when(F.col("kind") == "table", F.array("text", F.lit("u\nv"))))).first().csv == 'Paragraph,"a ""b"", c"\r\nParagraph,i\r\nt,"u\nv"\r\n'
    assert sink.plain(rows, F.lit("T")).select(F.expr(sink.finished("text")).alias("x")).first().x == 'T\n=\n\na "b", c\nt\ni\n'
    assert sink.html(rows.limit(1)).first().html == "<p>a &quot;b&quot;, c</p>"


def test_hooks_and_registry():
    hooks, seen = Hooks(), []

    def broken():
        raise ValueError

    hooks.register("e", broken)
    hooks.register("e", lambda: seen.append(1) or 5)
    assert hooks.trigger("e") == [5] and seen == [1] and hooks.trigger("other") == []
    hooks.unregister("e", broken)
    hooks.unregister("e", broken)
    assert len(hooks.of("e")) == 1
    registry = Registry()
    registry.add("renderer", "HTML", len)
    assert registry.get("renderer", "html") is len and registry.names("renderer") == ["html"]
    try:
        registry.get("parser", "x")
    except KeyError as e:
        assert "none" in str(e)


def test_short_and_long_ways_through_a_paragraph_agree(monkeypatch):
    """Paragraphs of plain runs are read without a walk, and say what the walk says; whatever else a paragraph holds takes the walk."""
    from xml.etree import ElementTree as ET

    from lamina.sources import package

    w = package.W[1:-1]
    bold = '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr>'
    plain = ["", "<w:r><w:t>a</w:t></w:r>", f"<w:pPr><w:rPr><w:b/></w:rPr></w:pPr><w:r>{bold}<w:t>a</w:t></w:r><w:r><w:t/></w:r><w:r><w:t>b</w:t></w:r>"]
    other = ["<w:r/>", "<w:r><w:tab/></w:r>", "<w:r><w:t>a</w:t><w:t>b</w:t></w:r>", "<w:hyperlink><w:r><w:t>a</w:t></w:r></w:hyperlink>", '<w:r><w:footnoteReference w:id="2"/></w:r>', '<w:fldSimple w:instr="PAGE"/>', "<w:r><w:br/><w:t>a</w:t></w:r>", "<w:r><w:t>a<w:r><w:t>b</w:t></w:r></w:t></w:r>", f"<w:r><w:t>a</w:t>{bold}</w:r>"]
    for inner, short in [(x, True) for x in plain] + [(x, False) for x in other]:
        node = ET.fromstring(f'<w:p xmlns:w="{w}">{inner}</w:p>')
        assert (package.plain_runs(node) is not None) == short
        said = package.runs(node)
        with monkeypatch.context() as m:
            m.setattr(package, "plain_runs", lambda p: None)
            assert said == package.runs(node)


def test_only_the_chosen_columns_are_made(spark):
    """Python makes and sends what a query uses; nested values come out of Arrow as ``to_pylist`` gives them."""
    import pyarrow as pa

    from lamina.sinks import package as sink
    from lamina.sources import package

    blocks = [{"kind": "table", "cells": [["a", "b"], ["c", ""]], "runs": None}, {"kind": None, "cells": None, "runs": [{"text": "x", "bold": None}, None]}]
    nested = pa.array([{"blocks": blocks, "m": [("k", "v")], "n": 1}, {"blocks": None, "m": None, "n": None}, None], pa.struct([("blocks", pa.list_(pa.struct([("kind", pa.string()), ("cells", pa.list_(pa.list_(pa.string()))), ("runs", pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_())])))]))), ("m", pa.map_(pa.string(), pa.string())), ("n", pa.int64())]))
    assert sink.plain(nested) == nested.to_pylist() and sink.plain(nested[1:]) == nested[1:].to_pylist()
    own = spark.createDataFrame([(1, [{"kind": "table", "cells": [["a", "b"]]}])], "doc_id long, blocks array<struct<kind: string, cells: array<array<string>>>>")
    found = package.scan(sink.write_documents(own), "elements", "doc_id", columns=["kind", "text", "properties"])
    assert found.columns == ["doc_id", "kind", "text", "properties"]
    assert [(r.text, r.properties["tcW.w"]) for r in found.filter("kind = 'cell'").orderBy("text").collect()] == [("a", "2000"), ("b", "2000")]
