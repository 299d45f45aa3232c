"""Packages with damage, nested tables and parsers of one's own; media, HTML files, options, plugins and one-call helpers."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lamina import api, plugins
from lamina.document import Documents
from lamina.sinks import package as sink
from lamina.sinks.options import Options
from lamina.sources import html, media, package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(body: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, data in more.items():
            z.writestr(f"word/{name}.xml", data)
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


NESTED = f"<w:tbl><w:tblPr><w:tblStyle w:val='Grid'/></w:tblPr><w:tblGrid><w:gridCol w:w='100'/><w:gridCol w:w='x'/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val='many'/><w:vMerge/><w:shd w:fill='FF0000'/></w:tcPr>{p('a')}<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>{p('b')}</w:tc></w:tr></w:tbl>"


def test_scan_of_awkward_packages(spark):
    good = packed(NESTED + "<w:custom w:val='7'/>" + p("end"), styles=f"<w:styles {W}><w:style w:styleId='S'><w:pPr><w:ind w:left='720'/><w:keepNext/></w:pPr></w:style></w:styles>")
    rows = [("good", good), ("cut", good[:50]), ("none", None), ("xml", packed("<w:p>")), ("empty", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = package.scan(df, "elements").collect()
    cells = {r.place: (r.text, r.depth, r.span, r.v_merge, r.properties) for r in found if r.kind == "cell"}
    assert cells["table[0].0.0"] == ("a\nb", 0, 1, "continue", {"gridSpan": "many", "vMerge": "true", "shd.fill": "FF0000"}) and cells["table[0].0.0.table[0].0.0"][:2] == ("in", 1)
    assert {r.path for r in package.errors(df).collect() if r.kind == "package"} == {"cut", "none", "empty"}
    assert package.scan(df, "styles").first().properties == {"ind.left": "720", "keepNext": "true"}
    assert package.scan(df, "tables").first().grid == [100, 0]
    own = package.scan(df, "elements", parsers={"custom": lambda node: [{"kind": "custom", "text": node.get(package.W + "val")}]}).filter("kind = 'custom'").collect()
    assert [(r.seq, r.text) for r in own] == [(1, "7")]
    broken = package.unpack(df, "elements", "styles", parsers={"custom": lambda node: 1 / 0})
    assert {(r.path, r.kind) for r in package.rows_of(broken, "errors").collect()} >= {("good", "elements")} and package.rows_of(broken, "styles").count() == 1
    assert package.scan(df.filter("false"), "elements").count() == 0


def test_writer_keeps_a_template(spark):
    template = sink.document_bytes({"styles": [{"style_id": "T", "type": None, "name": "t", "based_on": None, "properties": None}], "blocks": [{"runs": [{"text": "old"}]}]})
    media_rows = [{"rel_id": "rId9", "name": "a.png", "content": b"\x89PNG"}]
    content = sink.document_bytes({"blocks": [{"runs": [{"text": "n < & >", "bold": True, "font_name": "Lato"}], "picture": "rId9", "num_id": "1"}], "media": media_rows, "properties": {"title": "T"}}, template)
    df = spark.createDataFrame([("d", content)], "path string, content binary")
    run = package.scan(df, "runs").first()
    assert (run.text, run.bold, run.font_name) == ("n < & >", True, "Lato") and package.scan(df, "styles").first().style_id == "T"
    assert package.scan(df, "elements").filter("kind = 'image'").first().rel_id == "rId9" and package.scan(df, "parts").filter("content_type IS NULL").count() == 0


def test_html_tables_in_tables_and_files(spark, tmp_path):
    rows = html.scan("<table><tr><td>one<table><tr><td>in</td></tr></table>two</td><td>three</td></tr></table><p>after</p>")
    assert [(r["kind"], r["text"], r.get("table_seq"), r.get("col_idx")) for r in rows] == [("cell", "in", 1, 0), ("cell", "one\ntwo", 0, 0), ("cell", "three", 0, 1), ("paragraph", "after", None, None)]
    (tmp_path / "a.html").write_text("<p>x\ny</p>")
    assert html.scan_pages(html.read_pages(spark, f"file://{tmp_path}/*.html"), "path").first().text == "x\ny"
    assert html.read_pages(spark, f"file://{tmp_path}/gone").count() == 0


def test_media_store(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x89PNG\r\n")
    (tmp_path / "b.png").write_bytes(b"%PDF-1")
    assert {r.path[-5:]: (r.type, r["size"]) for r in media.read_media(spark, f"file://{tmp_path}").collect()} == {"a.bin": ("image", 6), "b.png": ("pdf", 6)}


def test_options():
    options = Options(a=1).set("b", 2).update(c=None)
    assert options.default("a", 5) == 1 and options.default("d", 4) == 4 and options.get("d") == 4 and options.get("z", 0) == 0


def test_plugins():
    seen = []

    class Plugin:
        def __init__(self, name, fails=False):
            self.name, self.fails = name, fails

        def start(self, context):
            if self.fails:
                raise ValueError
            context["registry"].add("parser", self.name, len)
            seen.append(("start", self.name, context["x"]))

        def stop(self):
            seen.append(("stop", self.name))

    manager = plugins.PluginManager({"x": 1})
    for plugin in (Plugin("a"), Plugin("bad", True), Plugin("b")):
        manager.add(plugin)
    with pytest.raises(ValueError):
        manager.add(Plugin("a"))
    assert manager.start() == ["a", "b"] == manager.start() and manager.registry.get("parser", "a") is len
    manager.remove("a")
    manager.stop()
    assert seen == [("start", "a", 1), ("start", "b", 1), ("stop", "a"), ("stop", "b")] and manager.running() == []


def test_one_call_helpers(spark, tmp_path):
    documents = Documents.from_text(spark.createDataFrame([(1, "one\ntwo {Name}")], "doc_id long, text string"))
    assert api.render(documents, "TEXT").first().text.endswith("two {Name}\n")
    with pytest.raises(KeyError):
        api.render(documents, "nope")
    api.register_format("count", lambda d: d.rows.groupBy("doc_id").count())
    assert api.render(api.merge_documents(documents, documents), "count").first()["count"] == 4
    (tmp_path / "a.docx").write_bytes(packed(p("Dear {Name}")))
    assert api.convert(spark, f"file://{tmp_path}/*.docx", "text").count() == 1
    opened = api.open_documents(spark, f"file://{tmp_path}/*.docx")
    data = opened.rows.select("doc_id").distinct().withColumn("n", F.lit("Ann"))
    assert api.fill_template(spark, f"file://{tmp_path}/*.docx", data, Name="n").of_kind("paragraph").first().text == "Dear Ann"
