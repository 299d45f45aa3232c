"""Writers, readers of drawings and metafiles, assembly, list indents, cache, streams and the command line."""

from __future__ import annotations

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lamina import __main__ as command
from lamina.cache import Cache
from lamina.document import Documents
from lamina.functions import metafile
from lamina.operators import assembly, lists, tables
from lamina.sinks import package as package_sink
from lamina.sinks import pdf, workbook
from lamina.sources import drawings, layout_json, package
from lamina.streaming import documents as stream

TEXTS = ["plain", "", "a (b) \\ c)", "é ü ß €", "Ελλάδα 𝄞", "two\nlines\r"]


def test_pdf_holds_every_text():
    pages = [[{"x": 72, "y": 80 + i, "size": 11, "bold": i == 1, "text": t} for i, t in enumerate(TEXTS)], [], [{"x": 1, "y": 2, "size": 3, "text": "last"}]]
    content = pdf.pdf_bytes(pages, "Titel")
    assert pdf.page_texts(content) == [TEXTS, [], ["last"]]
    table = int(content.rsplit(b"startxref\n", 1)[1].split()[0])
    offsets = [int(line[:10]) for line in content[table:].split(b"\n")[3:] if line.endswith(b" n ")]
    assert all(content[o:].startswith(b"%d 0 obj" % n) for n, o in enumerate(offsets, 1)) and b"/Count 3" in content
    assert pdf.page_texts(pdf.pdf_bytes([])) == [[]]


def test_pdf_of_documents(spark):
    docs = Documents.from_text(spark.createDataFrame([(1, "x\n" * 120), (2, "word " * 200), (3, None)], "doc_id long, text string"))
    found = {r.doc_id: pdf.page_texts(bytes(r.content)) for r in docs.to_pdf().collect()}
    assert [len(p) for p in found[1]] == [50, 50, 21] and set(found) == {1, 2}
    assert " ".join(found[2][0]).split() == ["word"] * 200 and max(map(len, found[2][0])) <= 68


def test_workbook():
    rows = [(["Name", "Sum"], True), (["a<&>\"", "x" * 80], False), ([], False), (["_x0041_", "\x01 \n", None], False)]
    content = workbook.workbook_bytes(rows, "S")
    assert workbook.sheet_rows(content) == [["Name", "Sum"], ["a<&>\"", "x" * 80], [], ["_x0041_", "\x01 \n", ""]]
    sheet = zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml").decode()
    assert 'min="1" max="1" width="9"' in sheet and 'min="2" max="2" width="50"' in sheet and '<c r="A1" s="1"' in sheet
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert workbook.sheet_rows(workbook.workbook_bytes([])) == []


def test_workbook_puts_headers_first(spark):
    schema = "doc_id long, seq int, kind string, text string, row_idx int, cells array<string>, is_header boolean"
    rows = spark.createDataFrame([(1, 0, "paragraph", " ", 0, None, None), (1, 1, "table", "", 0, ["a"], False), (1, 1, "table", "", 1, ["h"], True), (1, 2, "paragraph", "p", 0, None, None), (1, 3, "table", "", 0, ["b", None], None)], schema)
    assert workbook.sheet_rows(bytes(workbook.write_workbooks(workbook.row_plan(rows)).first().content)) == [["Table 1"], ["h"], ["a"], ["Paragraph", "p"], ["Table 2"], ["b", ""]]


def emf(*records: tuple[int, bytes]) -> bytes:
    head = struct.pack("<II4i4iI", 1, 108, 0, 0, 100, 50, 0, 0, 1000, 500, 0x464D4520).ljust(108, b"\0")
    return head + b"".join(struct.pack("<II", kind, 8 + len(d)) + d for kind, d in records) + struct.pack("<II", 14, 20).ljust(20, b"\0")


def test_emf_as_svg():
    text = "Hé<".encode("utf-16-le").ljust(8, b"\0")
    drawn = metafile.to_svg(emf(
        (9, struct.pack("<ii", 200, 100)), (38, struct.pack("<IIiiI", 1, 1, 2, 0, 0x0000FF)), (37, struct.pack("<I", 1)), (39, struct.pack("<III", 2, 0, 0x00FF00)), (37, struct.pack("<I", 2)),
        (43, struct.pack("<4i", 10, 20, 30, 60)), (42, struct.pack("<4i", 0, 0, 10, 20)), (27, struct.pack("<ii", 1, 2)), (54, struct.pack("<ii", 3, 4)), (54, struct.pack("<ii", 5, 6)),
        (86, struct.pack("<4iI", 0, 0, 0, 0, 3) + struct.pack("<6h", 0, 0, 9, 0, 9, 9)), (59, b""), (27, struct.pack("<ii", 0, 0)), (54, struct.pack("<ii", 7, 7)), (61, b""), (60, b""), (64, struct.pack("<4i", 0, 0, 0, 0)),
        (37, struct.pack("<I", 0x80000005)), (33, b""), (24, struct.pack("<I", 0xFF0000)), (84, struct.pack("<4iIff", 0, 0, 0, 0, 1, 1, 1) + struct.pack("<iiIIIIIIII", 11, 12, 3, 76, 0, 0, 0, 0, 0, 0)[:40] + text), (34, struct.pack("<i", -1)),
    ))
    assert drawn.startswith('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 100">')
    assert '<rect x="10" y="20" width="20" height="40" fill="#00FF00" stroke="#FF0000" stroke-width="2" stroke-dasharray="6 3"/>' in drawn
    assert '<ellipse cx="5" cy="10" rx="5" ry="10"' in drawn and 'd="M1,2L3,4"' in drawn and 'd="M3,4L5,6"' in drawn and 'd="M0,0L9,0 9,9Z" fill="#00FF00"' in drawn
    assert 'd="M0,0L7,7Z" fill="none"' in drawn
    assert '<text x="11" y="12" font-family="sans-serif" font-size="12" fill="#0000FF">Hé&lt;</text>' in drawn


def test_wmf_and_broken_files(spark):
    record = lambda kind, d: struct.pack("<IH", 3 + len(d) // 2, kind) + d
    head = struct.pack("<IHhhhhHIH", 0x9AC6CDD7, 0, 0, 0, 40, 30, 96, 0, 0) + b"\0" * 18
    wmf = head + record(0x020C, struct.pack("<hh", 30, 40)) + record(0x02FC, struct.pack("<HIH", 0, 0x0000FF, 0)) + record(0x012D, struct.pack("<H", 0)) + record(0x041B, struct.pack("<4h", 20, 10, 5, 1)) + record(0, b"")
    assert metafile.to_svg(wmf) == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 40 30"><rect x="1" y="5" width="9" height="15" fill="#FF0000" stroke="#000000" stroke-width="1"/></svg>'
    rng = random.Random(5)
    whole = emf((43, struct.pack("<4i", 1, 2, 3, 4)), (86, struct.pack("<4iI", 0, 0, 0, 0, 3) + b"\0" * 12))
    for _ in range(300):
        broken = bytearray(whole)
        broken[rng.randrange(44, len(broken))] = rng.randrange(256)
        assert metafile.to_svg(bytes(broken[: rng.randrange(44, len(broken))])).startswith("<svg")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9) + zlib.compress(b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x00\x00\x00"
    rows = spark.createDataFrame([(1, png), (2, b"GIF89a\x03\0\x04\0"), (3, jpeg), (4, b"?"), (5, None), (6, whole)], "id int, content binary")
    assert {r.id: (r.i.width, r.i.height, r.s is not None) for r in rows.select("id", metafile.image_info("content").alias("i"), metafile.svg("content").alias("s")).collect()} == {1: (7, 9, False), 2: (3, 4, False), 3: (6, 5, False), 4: (None, None, False), 5: (None, None, False), 6: (100, 50, True)}


DRAWN = """<w:document xmlns:w="{w}" xmlns:wp="{wp}" xmlns:a="{a}" xmlns:r="{r}" xmlns:mc="{mc}" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:c="{c}"><w:body><w:p>
<w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="457200"/><wp:docPr id="1" name="Logo"/><a:graphic><a:blip r:embed="rId7"/></a:graphic></wp:inline></w:drawing></w:r>
<w:r><mc:AlternateContent><mc:Choice Requires="wps"><w:drawing><wp:anchor><wp:positionH><wp:posOffset>12700</wp:posOffset></wp:positionH><wp:extent cx="x" cy="12700"/><a:prstGeom prst="rect"/><w:txbxContent><w:p><w:r><w:t>in</w:t></w:r><w:r><w:t>side</w:t></w:r></w:p><w:p/></w:txbxContent></wp:anchor></w:drawing></mc:Choice><mc:Fallback><w:pict><v:shape id="no"/></w:pict></mc:Fallback></mc:AlternateContent></w:r>
<w:r><mc:AlternateContent><mc:Choice Requires="x"/><mc:Fallback><w:pict><v:shape id="S" type="#t136" style="width:36pt;height:1in"><v:textpath string="DRAFT"/></v:shape></w:pict></mc:Fallback></mc:AlternateContent></w:r>
<w:r><w:drawing><wp:inline><c:chart r:id="rId9"/></wp:inline></w:drawing></w:r></w:p></w:body></w:document>"""


def test_drawings_charts_diagrams_fonts(spark):
    space = {k: v[1:-1] for k, v in {"w": drawings.W, "wp": drawings.WP, "a": drawings.A, "r": drawings.R, "mc": drawings.MC, "c": drawings.C}.items()}
    chart = f'<c:chartSpace xmlns:c="{space["c"]}"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:v>Sales</c:v></c:tx><c:cat><c:pt idx="0"><c:v>Q1</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>5</c:v></c:pt><c:pt idx="1"><c:v>6</c:v></c:pt></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
    diagram = f'<d:dataModel xmlns:d="{drawings.D[1:-1]}" xmlns:a="{space["a"]}"><d:ptLst><d:pt modelId="1" type="node"><a:t> one </a:t><a:t>two</a:t></d:pt></d:ptLst><d:cxnLst><d:cxn modelId="9" srcId="1" destId="2"/></d:cxnLst></d:dataModel>'
    fonts = f'<w:fonts xmlns:w="{space["w"]}"><w:font w:name="Lato"><w:family w:val="swiss"/></w:font></w:fonts>'
    content = package_sink.package_bytes([], extra={"word/document.xml": DRAWN.format(**space), "word/charts/chart1.xml": chart, "word/diagrams/data1.xml": diagram, "word/fontTable.xml": fonts, "word/fonts/f1.ttf": "OTTOrest"})
    rows = spark.createDataFrame([("p", content), ("no zip", b"x")], "path string, content binary")
    found = [(r.kind, r.placed, r.rel_id, r.width, r.height, r.x, r.shape, r.name, r.text) for r in package.scan(rows, "drawings").orderBy("seq").collect()]
    assert found == [("image", "inline", "rId7", 72.0, 36.0, None, None, "Logo", None), ("textbox", "anchor", None, None, 1.0, 1.0, "rect", None, "inside\n"), ("watermark", "vml", None, 36.0, 72.0, None, "t136", "S", "DRAFT"), ("chart", "inline", "rId9", None, None, None, None, None, None)]
    assert [(r.kind, r.name, r.label, r.value) for r in package.scan(rows, "charts").orderBy("idx").collect()] == [("barChart", "Sales", "Q1", "5"), ("barChart", "Sales", None, "6")]
    assert {(r.kind, r.text, r.source, r.target) for r in package.scan(rows, "diagrams").collect()} == {("point", "one two", None, None), ("connection", None, "1", "2")}
    assert {(r.kind, r.name, r.family, r.format, r.size) for r in package.scan(rows, "fonts").collect()} == {("declared", "Lato", "swiss", None, None), ("file", "f1.ttf", None, "otf", 8)}


def block(seq: int, lines: int, **other) -> dict:
    return {"seq": seq, "kind": "paragraph", "lines": lines, "line_h": 10.0, "before": 0.0, "after": 0.0, "break_before": False, "break_after": False, "keep": False, "notes_h": 0.0} | other


def places(blocks: list[dict], usable: float = 100.0) -> list[tuple]:
    return [(r["seq"], r["page"], r["first_line"], r["n_lines"], r["y"]) for r in assembly.assemble(blocks, usable)]


def test_assembly_rules():
    assert places([block(0, 8), block(1, 5)]) == [(0, 1, 0, 8, 0.0), (1, 1, 0, 2, 80.0), (1, 2, 2, 3, 0.0)]
    assert places([block(0, 8), block(1, 3)]) == [(0, 1, 0, 8, 0.0), (1, 2, 0, 3, 0.0)]  # two lines here would leave one alone
    assert places([block(0, 9), block(1, 3, kind="table")]) == [(0, 1, 0, 9, 0.0), (1, 1, 0, 1, 90.0), (1, 2, 1, 2, 0.0)]
    assert places([block(0, 8), block(1, 5, keep=True)]) == [(0, 1, 0, 8, 0.0), (1, 2, 0, 5, 0.0)]
    assert places([block(0, 2, after=5.0), block(1, 2, before=8.0), block(2, 1, break_after=True), block(3, 1)]) == [(0, 1, 0, 2, 0.0), (1, 1, 0, 2, 28.0), (2, 1, 0, 1, 48.0), (3, 2, 0, 1, 0.0)]
    assert places([block(0, 2, notes_h=30.0), block(1, 4)]) == [(0, 1, 0, 2, 0.0), (1, 1, 0, 2, 20.0), (1, 2, 2, 2, 0.0)]
    assert places([block(0, 1, kind="endnote"), block(1, 1)]) == [(1, 1, 0, 1, 0.0), (0, 1, 0, 1, 10.0)]
    assert places([block(0, 25, keep=True)]) == [(0, 1, 0, 10, 0.0), (0, 2, 10, 10, 0.0), (0, 3, 20, 5, 0.0)]
    assert places([block(0, 1, kind="image", line_h=300.0), block(1, None)]) == [(0, 1, 0, 1, 0.0), (1, 2, 0, 1, 0.0)]


def test_assembly_keeps_every_line(spark):
    rng = random.Random(3)
    for _ in range(300):
        blocks = [block(i, rng.randint(1, 30), kind=rng.choice(["paragraph", "table"]), line_h=rng.choice([5.0, 12.0, 0.0, 130.0]), before=rng.choice([0.0, 7.0]), after=rng.choice([0.0, 9.0]), keep=rng.random() < 0.2, notes_h=rng.choice([0.0, 0.0, 20.0, 90.0]), break_before=rng.random() < 0.1) for i in range(rng.randint(1, 12))]
        found = assembly.assemble(blocks, 100.0)
        for b in blocks:
            own = [r for r in found if r["seq"] == b["seq"]]
            assert [r["first_line"] for r in own] == [sum(x["n_lines"] for x in own[:i]) for i in range(len(own))] and sum(r["n_lines"] for r in own) == b["lines"]
        assert [r["page"] for r in found] == sorted(r["page"] for r in found) and {r["page"] for r in found} == set(range(1, found[-1]["page"] + 1))
        for a, b in zip(found, found[1:], strict=False):
            assert a["page"] < b["page"] or b["y"] >= a["y"] + a["h"] - 1e-6
    schema = "doc_id long, seq int, kind string, lines int, line_h double, before double, after double, break_before boolean, break_after boolean, keep boolean, notes_h double"
    rows = spark.createDataFrame([(1, 0, "paragraph", None, None, None, None, None, None, None, None), (1, 1, None, 70, 10.0, 0.0, 0.0, False, False, False, 0.0)], schema)
    assert [(r.seq, r.page, r.n_lines) for r in assembly.assembled(rows).orderBy("seq", "page").collect()] == [(0, 1, 1), (1, 1, 68), (1, 2, 2)]
    assert assembly.assembled(rows.limit(0)).count() == 0


def test_list_indents(spark):
    sides = ", ".join(f"{p}{x} double" for p in ("", "style_") for x in lists.SIDES)

    def item(seq, num_id, level=0, marker="", **other):
        return {"doc_id": 1, "seq": seq, "num_id": num_id, "level": level, "marker": marker, "explicit": False, "style_is_list": False} | {f"{p}{x}": 0.0 for p in ("", "style_") for x in lists.SIDES} | other

    items = [item(0, "a"), item(1, "a", 1), item(2, "b"), item(3, None, style_left=7.0, left=9.0), item(4, None, style_is_list=True, marker="x"), item(5, "a", left=5.0, explicit=True), item(6, "c", 0, "1.1.1"), item(7, "a", None, None, left=None), item(8, "d", 3)]
    own = spark.createDataFrame(items, f"doc_id long, seq int, num_id string, level int, marker string, explicit boolean, style_is_list boolean, {sides}")
    levels = [("a", 0, 36.0, 18.0, "%1.", False), ("a", 1, 36.0, 18.0, "%2)", False), ("b", 0, 50.0, 18.0, "%1.", False), ("c", 0, 10.0, 0.0, "", None)]
    levels = spark.createDataFrame([(n, k, left, 0.0, 0.0, hanging, text, "decimal", over) for n, k, left, hanging, text, over in levels], "num_id string, level int, left double, right double, first_line double, hanging double, text string, format string, overridden boolean")
    found = lists.indented(own, levels).orderBy("seq").collect()
    # a second level adds the first one's sides; equal markers follow the first; a hanging indent has room for its marker
    assert [(r["mode"], r["left"], r["hanging"]) for r in found[:7]] == [("auto", 39.0, 21.0), ("auto", 72.0, 36.0), ("auto-match", 39.0, 21.0), ("none", 9.0, 0.0), ("continuation", 50.0, 18.0), ("auto-match", 5.0, 18.0), ("auto", 43.0, 33.0)]
    assert found[7]["mode"] == "auto-match" and found[7]["left"] == 39.0 and found[8]["mode"] == "auto" and found[8]["left"] == 9.0
    assert [r["number_start"] for r in found[:3]] == [18.0, 36.0, 18.0] and found[1]["text_start"] == 72.0
    assert lists.indented(own.limit(0), levels).count() == 0


def test_layout_json(spark):
    rows = spark.createDataFrame([(1, '{"version":"2.0","styles":[{"b":1}],"pages":[{"n":1,"size":[10,20],"blocks":[{"t":"p","s":0,"c":{"x":1},"f":[1,2,3,4],"seq":5},{"t":"q"}],"h":[{"t":"h","c":"top"}]}]}'), (2, "no json"), (3, None), (4, "{}")], "doc_id long, json string")
    found = {(r.part, r.idx): (r.kind, r.x, r.h, r.style, r.text, r.width) for r in layout_json.scan(rows).collect()}
    assert found == {("body", 0): ("p", 1.0, 4.0, '{"b":1}', '{"x":1}', 10.0), ("body", 1): ("q", None, None, None, None, 10.0), ("header", 0): ("h", None, None, None, "top", 10.0)}


def test_border_groups_and_widths(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(["a", "a", None, None, "a", "b", "b", "b"])], "doc_id int, seq int, border string")
    assert {(r.first_seq, r.last_seq, r.n) for r in tables.border_groups(rows, "border").collect()} == {(0, 1, 2), (5, 7, 3)}
    cells = spark.createDataFrame([(1, 0, 5.0), (1, 1, 170.0), (1, 1, None), (2, 0, None)], "t int, c int, w double")
    assert {(r.t, r.c): r.width for r in tables.autofit_widths(cells, "t", "c", "w", 100.0).collect()} == {(1, 0): 10.0, (1, 1): 90.0, (2, 0): 20.0}


def test_cache():
    now = [0.0]
    cache = Cache(ttl=10, capacity=2, clock=lambda: now[0])
    assert cache.get_or_set("a", lambda: None) is None and cache.get_or_set("a", lambda: 1) is None
    cache.set("b", 2, ttl=50)
    cache.set("c", 3)
    assert cache.get("a", "gone") == "gone" and cache.get("b") == 2 and cache.stats()["size"] == 2
    now[0] = 10.0
    assert cache.get("c") is None and cache.get("b") == 2 and cache.drop("b") and not cache.drop("b")


def test_stream_of_packages(spark, tmp_path):
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for round_, name in enumerate(("a", "b")):
        (folder / f"{name}.docx").write_bytes(package_sink.package_bytes([(f"{name} one", None), ("two", None)]))
        query = stream.each_batch(stream.elements(spark, f"file://{folder}"), lambda d: d.text(), f"file://{target}", f"file://{tmp_path}/check", once=True)
        query.awaitTermination()
        assert sorted(r.text for r in spark.read.parquet(f"file://{target}").collect()) == ["a one\ntwo", "b one\ntwo"][: round_ + 1]


@pytest.mark.parametrize("to", command.FORMATS)
def test_command_converts(spark, tmp_path, to):
    body = '<w:document xmlns:w="{0}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'.format(drawings.W[1:-1])
    (tmp_path / "a.docx").write_bytes(package_sink.package_bytes([], extra={"word/document.xml": body}))
    assert command.main(["convert", f"file://{tmp_path}/*.docx", f"file://{tmp_path}/out", "--to", to], spark) == 0
    row = spark.read.parquet(f"file://{tmp_path}/out").first()
    if to == "xlsx":
        assert workbook.sheet_rows(bytes(row.content)) == [["Paragraph", "Hello"], ["Table 1"], ["c1", "c2"]]
    elif to == "pdf":
        assert pdf.page_texts(bytes(row.content)) == [["Hello", "c1", "c2"]]
    elif to == "nested_json":
        assert '"table":{"rows":[{"cells":[{"text":"c1"},{"text":"c2"}]}]}' in row.json
    elif to != "docx":
        assert "Hello" in row[1]


def test_command_others(spark, tmp_path, capsys):
    assert command.main(["version"]) == 0 and command.main(["queries"]) == 0 and "pdf_round_trip" in capsys.readouterr().out
    assert command.main(["query", "nothing", "x"], spark) == 2
    spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/t")
    assert command.main(["pipeline", f"file://{tmp_path}/t", f"file://{tmp_path}/p", "--kind", "texts"], spark) == 0
    assert {(r.doc_id, r.seq, r.page) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()} == {(1, 0, 1), (1, 1, 1), (2, 0, 1)}
    assert command.main(["info", f"file://{tmp_path}/t", "--kind", "texts"], spark) == 0


def test_pages_and_files_leave_python_a_few_at_a_time():
    """However many rows a batch of Arrow has, only some are Python objects at a time."""
    import pyarrow as pa

    from lamina import scratch
    from lamina.sources import html

    class Frame:
        dtypes = [("page_id", "bigint"), ("html", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, kind):  # noqa: N802
            return run

    seen = []
    batch = pa.record_batch([pa.array(range(100)), pa.array(["<p>a</p><p>b</p>", None, "<p>" + "x" * 9] * 33 + [""])], ["page_id", "html"])
    out = list(html.scan_pages(Frame())(iter([batch])))
    assert len(out) == 4 and max(b.num_rows for b in out) <= 64 and [r["text"] for b in out for r in b.to_pylist() if r["page_id"] == 0] == ["a", "b"]
    first = next(scratch.by_row(Frame(), lambda k, h: seen.append(k) or [(k,)], "k bigint", rows=7)(iter([batch])))
    assert seen == list(range(7)) and first.column(0).to_pylist() == seen
