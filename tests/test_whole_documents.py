"""Part graphs, full merges, fills, normalisation, lines, and a writer whose packages another reader checks."""

from __future__ import annotations

import io
import random
import re
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lamina import scratch
from lamina.document import Documents
from lamina.operators import elements, fill, full_merge, linebreak, merging, normalize, parts, styles
from lamina.plans import registry
from lamina.sinks import package as sink
from lamina.sources import package

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELS = "doc_id long, source string, rel_id string, type string, target string, target_mode string"


def test_part_names(spark):
    rows = [("word/document.xml", "media/a.png", "word/media/a.png"), ("word/charts/c.xml", "../../../x/./y.xml", "x/y.xml"), ("", "word/document.xml", "word/document.xml"), ("word/a.xml", "/b.xml", "b.xml"), ("word/a.xml", "b/c/../../d.xml", "word/d.xml")]
    found = spark.createDataFrame(rows, "source string, target string, want string").select(parts.part_name().alias("got"), "want", parts.target_from("source", "want").alias("back"), "source").collect()
    assert [r.got for r in found] == [r.want for r in found]
    again = spark.createDataFrame([(r.source, r.back, r.want) for r in found], "source string, target string, want string").select(parts.part_name().alias("got"), "want").collect()
    assert [r.got for r in again] == [r.want for r in again]


def test_reachable_is_brute_force(spark):
    rng = random.Random(4)
    steps = [(d, f"p{rng.randrange(12)}", f"p{rng.randrange(12)}") for d in range(6) for _ in range(14)]
    roots = [(d, f"p{k}") for d in range(6) for k in range(0, d % 3 + 1)]
    want = {}
    for d, root in roots:
        frontier, depth = {root}, 0
        while frontier:
            for p in frontier:
                want[d, p] = min(depth, want.get((d, p), 99))
            depth += 1
            frontier = {b for x, a, b in steps if x == d and a in frontier and want.get((d, b), 99) > depth}
    found = parts.reachable(spark.createDataFrame(roots, "doc_id long, part string"), spark.createDataFrame(steps, "doc_id long, part string, to string")).collect()
    assert {(r.doc_id, r.part): r.depth for r in found} == want and len(found) == len(want)


def test_copies(spark):
    """A chain of five parts, one that two share, a way back to the body, a target that isn't there, and a name that both sides have."""
    names = ["word/document.xml", *(f"word/x{i}.xml" for i in range(1, 6)), "word/media/pic.png"]
    source = spark.createDataFrame([(1, n, f"s{n}") for n in names], "doc_id long, part string, digest string")
    target = spark.createDataFrame([(1, "word/document.xml", "t"), (1, "word/x3.xml", "other"), (1, "word/media/pic.png", "sword/media/pic.png")], "doc_id long, part string, digest string")
    rels = [(1, "word/document.xml", "rId1", "x", "x1.xml", None), (1, "word/document.xml", "rId2", "x", "gone.xml", "Internal"), (1, "word/document.xml", "rId3", "x", "unused.xml", "Internal")]
    rels += [(1, f"word/x{i}.xml", "rId1", "x", f"x{i + 1}.xml", "Internal") for i in range(1, 5)] + [(1, f"word/x{i}.xml", "rId7", "image", "media/pic.png", "Internal") for i in (1, 5)] + [(1, "word/x5.xml", "rId9", "x", "document.xml", "Internal")]
    theirs = spark.createDataFrame([(1, "word/document.xml", "rId4", "x", "x3.xml", "Internal")], RELS)
    used = spark.createDataFrame([(1, "word/document.xml", "rId1"), (1, "word/document.xml", "rId2")], "doc_id long, part string, rel_id string")
    found = parts.copied(target, theirs, source, spark.createDataFrame(rels, RELS), used)
    assert {(r.part, r.new_part, r.copied) for r in found.parts.collect()} == {("word/document.xml", "word/document.xml", False), ("word/media/pic.png", "word/media/pic.png", False), ("word/x3.xml", "word/x6.xml", True), *((f"word/x{i}.xml", f"word/x{i}.xml", True) for i in (1, 2, 4, 5))}
    assert {(r.source, r.old_id, r.rel_id, r.target) for r in found.relationships.collect()} == {("word/document.xml", "rId1", "rId5", "x1.xml"), ("word/x1.xml", "rId1", "rId1", "x2.xml"), ("word/x1.xml", "rId7", "rId2", "media/pic.png"), ("word/x2.xml", "rId1", "rId1", "x6.xml"), ("word/x6.xml", "rId1", "rId1", "x4.xml"), ("word/x4.xml", "rId1", "rId1", "x5.xml"), ("word/x5.xml", "rId7", "rId1", "media/pic.png"), ("word/x5.xml", "rId9", "rId2", "document.xml")}
    assert [(r.part, r.rel_id) for r in found.missing.collect()] == [("word/document.xml", "rId2")]


def document(mark: str, start: int = 1) -> dict:
    style = lambda i, base, **p: {"style_id": i, "type": "paragraph", "name": i, "based_on": base, "properties": p}
    blocks = [
        {"style": "H", "runs": [{"text": f"{mark} head", "bold": True, "font_size": "28"}, {"note": "footnote:2"}]}, {"style": "B", "num_id": "1", "level": 0, "runs": [{"text": f"{mark} item"}]},
        {"kind": "table", "style": "Grid", "header": True, "cells": [["a", "b"], [{"runs": [{"text": "wide", "italic": True}], "span": 2}]]}, {"picture": "rId9", "runs": [{"text": mark}]},
    ]
    return {
        "blocks": blocks, "styles": [style("H", "B", sz="28", jc="center"), style("B", None, **{"ind.left": "720", "rFonts.ascii": "Arial"}), style("Grid", None)], "notes": [{"kind": "footnote", "note_id": "2", "text": f"{mark} note"}],
        "numbering": [{"num_id": "1", "level": 0, "format": "decimal", "text": "%1.", "start": start, "properties": {"ind.left": "360"}}], "comments": [{"id": None, "author": "me", "date": None, "text": "why"}],
        "header": f"{mark} header", "media": [{"name": "image1.png", "content": mark.encode(), "rel_id": "rId9"}], "properties": {"title": mark, "creator": "me", "created": "2024-01-01T00:00:00Z"},
    }


def checked(content: bytes) -> dict[str, bytes]:
    """The parts of a package, read by the standard library alone: every part has a type and a relationship that leads to it, every reference a target, and properties follow the schema's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert len(set(z.namelist())) == len(z.namelist())
        found = {n: z.read(n) for n in z.namelist()}
    types = {n.get("PartName") or "*." + n.get("Extension"): n.get("ContentType") for n in ET.fromstring(found["[Content_Types].xml"])}
    reached = set()
    for name in [n for n in found if n.endswith(".rels")]:
        folder, _, file = name.rpartition("_rels/")
        ids = [r.get("Id") for r in ET.fromstring(found[name])]
        assert len(set(ids)) == len(ids) and (folder + file.removesuffix(".rels") in found or name == "_rels/.rels")
        for r in ET.fromstring(found[name]):
            if r.get("TargetMode") != "External":
                target = r.get("Target").lstrip("/") if r.get("Target").startswith("/") else folder + r.get("Target")
                assert target in found, target
                reached.add(target)
    for name in found:
        assert name == "[Content_Types].xml" or "/" + name in types or "*." + name.rpartition(".")[2] in types, name
        assert name == "[Content_Types].xml" or name.endswith(".rels") or name in reached, name
        if name.startswith("word/") and name.endswith(".xml"):
            assert types["/" + name] != "application/xml"
    body = ET.fromstring(found["word/document.xml"])
    ids = {r.get("Id") for r in ET.fromstring(found["word/_rels/document.xml.rels"])}
    assert {v for n in body.iter() for k, v in n.attrib.items() if k.startswith("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}")} <= ids
    for root in (body, *(ET.fromstring(found[n]) for n in ("word/styles.xml", "word/numbering.xml") if n in found)):
        for tag, order in (("pPr", sink.PARAGRAPH_ORDER + ["rPr"]), ("rPr", sink.RUN_ORDER)):
            for node in root.iter(W + tag):
                places = [order.index(c.tag.rpartition("}")[2]) for c in node]
                assert places == sorted(places)
    return found


def test_writer_keeps_the_schema():
    found = checked(sink.document_bytes(document("T")))
    body = ET.fromstring(found["word/document.xml"])
    style = ET.fromstring(found["word/styles.xml"]).find(W + "style")
    assert style.find(f"{W}rPr/{W}sz") is not None and style.find(f"{W}pPr/{W}jc") is not None and style.find(f"{W}pPr/{W}sz") is None
    assert len(list(body.iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}inline"))) == 1 and body.find(f".//{W}footnoteReference").get(W + "id") == "2"
    assert body.find(f".//{W}headerReference") is not None and b"coreProperties" in found["docProps/core.xml"] and ET.fromstring(found["docProps/core.xml"])[0].text == "T"


def test_writer_adds_to_a_template():
    """The template's header, image and other parts stay with their types and relationships; ids and names of the document's own give way."""
    template = sink.document_bytes(document("T") | {"header": "kept"})
    plain = {"blocks": [{"picture": "rId9", "runs": [{"text": "new"}]}], "media": [{"name": "image1.png", "content": b"own", "rel_id": "rId9"}]}
    found = checked(sink.document_bytes(plain, template))
    assert found["word/media/image1.png"] == b"T" and found["word/media/image2.png"] == b"own" and b"kept" in found["word/header1.xml"] and "word/styles.xml" in found
    body = ET.fromstring(found["word/document.xml"])
    rel = next(v for n in body.iter() for k, v in n.attrib.items() if k.endswith("}embed"))
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(found["word/_rels/document.xml.rels"])}
    assert target[rel] == "media/image2.png" and target[body.find(f".//{W}headerReference").get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")] == "header1.xml"
    other = checked(sink.document_bytes(plain | {"header": "mine"}, template))
    assert b"kept" in other["word/header1.xml"] and b"mine" in other["word/header2.xml"] and len(ET.fromstring(other["word/document.xml"]).findall(f".//{W}headerReference")) == 1


def test_nothing_is_lost_without_a_word(spark):
    rows = [(i, [{"runs": [{"text": t}]}]) for i, t in ((1, "good"), (2, "form\x0cfeed \x00and 😀".encode("utf-16", "surrogatepass").decode("utf-16")), (3, None))]
    out = sink.write_documents(spark.createDataFrame(rows, "doc_id long, blocks array<struct<runs: array<struct<text: string>>>>"))
    assert {r.doc_id: r.text for r in package.scan(out, "elements", "doc_id").collect()} == {1: "good", 2: "formfeed and 😀", 3: ""}
    broken = []
    for part in ("word/document.xml", "word/styles.xml", "word/_rels/document.xml.rels"):
        with zipfile.ZipFile(io.BytesIO(sink.document_bytes(document("T")))) as z:
            data = {n: z.read(n) for n in z.namelist()}
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n, x in data.items():
                z.writestr(n, x[:-9] if n == part else x)
        broken.append((part, bytearray(buffer.getvalue())))
    frame = spark.createDataFrame([*broken, ("fine", bytearray(sink.document_bytes(document("T"))))], "path string, content binary")
    assert {(r.path, r.kind, r.message.partition(":")[0]) for r in package.errors(frame).collect()} == {(p, "part", p) for p, _ in broken}
    assert {r.path for r in package.scan(frame, "styles").collect()} == {"word/document.xml", "word/_rels/document.xml.rels", "fine"}


def test_full_merge(spark, tmp_path):
    for side, start in (("T", 1), ("S", 4)):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.docx").write_bytes(sink.document_bytes(document(side, start)))
    (tmp_path / "S" / "lone.docx").write_bytes(sink.document_bytes(document("L")))
    target, source = (Documents.open(spark, f"file://{tmp_path}/{side}/*.docx") for side in "TS")
    out = target.merge_full(source)
    assert full_merge.dangling(out).collect() == [] and out["missing"].collect() == []
    rows = {(r.doc_id, r.part, r.seq, r.kind): r for r in out["elements"].collect()}
    assert rows["a.docx", "document", 5, "paragraph"].style == "H_merged" and rows["a.docx", "document", 5, "paragraph"].notes == ["footnote:3"] and rows["a.docx", "document", 6, "paragraph"].num_id == "2" and rows["a.docx", "document", 4, "page_break"]
    assert {r.style_id: r.based_on for r in out["styles"].filter("doc_id = 'a.docx'").collect()} == {"H": "B", "B": None, "Grid": None, "H_merged": "B_merged", "B_merged": None, "Grid_merged": None}
    assert {(r.num_id, r.start, r.abstract_id) for r in out["numbering"].filter("doc_id = 'a.docx'").collect()} == {("1", 1, 0), ("2", 4, 1)}
    assert {(r.note_id, r.text) for r in out["notes"].filter("doc_id = 'a.docx'").collect()} == {("2", "T note"), ("3", "S note")}
    assert rows["lone.docx", "document", 0, "paragraph"].style == "H" and {r.text for r in out["elements"].filter("part like 'header%' AND doc_id = 'a.docx'").collect()} == {"T header", "S header"}


def test_lists_keep_their_counters(spark):
    """Definitions of both sides are what they were, equal ones share an abstract list, and no instance of one side is the other's."""
    schema = "doc_id long, num_id string, level int, format string, text string, start int, properties map<string,string>"
    target = spark.createDataFrame([(1, "1", 0, "decimal", "%1.", 1, {"a": "1"}), (1, "5", 0, "bullet", "o", None, {})], schema)
    source = spark.createDataFrame([(1, "1", 0, "decimal", "%1.", 1, {"a": "1", "b": ""}), (1, "2", 0, "bullet", "o", 1, None), (1, "10", 0, "decimal", "%1)", 1, {})], schema)
    ids = full_merge.numbered_on(target, source, "num_id")
    assert {r.old: r.new for r in ids.collect()} == {"1": "6", "2": "7", "10": "8"}
    found = {r.num_id: (r.format, r.text, r.abstract_id) for r in full_merge.numbering_merged(target, source, ids).collect()}
    assert found == {"1": ("decimal", "%1.", 0), "5": ("bullet", "o", 1), "6": ("decimal", "%1.", 0), "7": ("bullet", "o", 1), "8": ("decimal", "%1)", 2)}
    xml = ET.fromstring(sink.numbering_xml([{"num_id": n, "abstract_id": a, "level": 0, "format": f, "text": t, "start": 1} for n, (f, t, a) in found.items()]))
    assert len(xml.findall(W + "abstractNum")) == 3 and len(xml.findall(W + "num")) == 5 and len(xml.findall(f".//{W}startOverride")) == 4


def hidden(rows: list[str], shows: dict[str, bool]) -> list[int]:
    """The rows that stay, by walking each hidden name's markers."""
    gone = set()
    for name in (n for n, s in shows.items() if not s):
        start = None
        for i, text in enumerate(rows):
            for side in re.findall(rf"\{{\{{(START|END)_{name}\}}\}}", text):
                if side == "START" and start is None:
                    start = i
                elif side == "END" and start is not None:
                    gone |= set(range(start, i + 1))
                    start = None
    return [i for i in range(len(rows)) if i not in gone]


def test_sections_are_brute_force(spark):
    rng = random.Random(11)
    docs = {d: ["".join(rng.choice(["x", "{{START_A}}", "{{END_A}}", "{{START_B}}", "{{END_B}}", "{{START_C}}", "{{END_C}}"]) for _ in range(rng.choice([1, 1, 2]))) for _ in range(14)] for d in range(40)}
    shows = {"A": False, "B": False, "C": True}
    rows = spark.createDataFrame([(d, i, "paragraph", t) for d, own in docs.items() for i, t in enumerate(own)], "doc_id long, seq int, kind string, text string")
    data = spark.createDataFrame([(d,) for d in docs], "doc_id long")
    found = fill.filled(rows, data, {}, None, {k: str(v).lower() for k, v in shows.items()}).collect()
    left: dict = {}
    for r in found:
        left.setdefault(r.doc_id, []).append(r.seq)
        assert "START_C" not in r.text and "END_C" not in r.text
    # markers of one name twice in a row meet in the order START, END
    same = {d: own for d, own in docs.items() if not any(re.search(r"END_(.).*START_\1", t) for t in own)}
    assert len(same) > 20 and {d: sorted(left.get(d, [])) for d in same} == {d: hidden(own, shows) for d, own in same.items()}


def test_fill_with_blocks(spark):
    rows = spark.createDataFrame([(1, 0, "document", "paragraph", "Dear {{ TEXT:Name }}: {Sum} {Loop} {Gone}", "S"), (1, 1, "document", "paragraph", "{{TABLE:T}}", "S"), (1, 2, "document", "paragraph", "see {IMAGE:I}", "S"), (1, 0, "header1", "paragraph", "{Name}", None), (2, 0, "document", "paragraph", "{Name}", None)], "doc_id long, seq int, part string, kind string, text string, style string")
    data = spark.createDataFrame([(1, "Ann", 2.5, [["h"], ["{Sum}"]])], "doc_id long, name string, total double, cells array<array<string>>")
    docs = Documents(rows).fill(data, {"TABLE:T": fill.table_block("cells"), "IMAGE:I": fill.image_block("'p.png'", "100")}, **{"TEXT:Name": "name", "CURRENCY:Sum": "total", "Loop": "'{Loop}!'", "Gone": "cast(NULL AS string)"})
    found = [(r.doc_id, r.part, r.seq, r.kind, r.text, r.cells, r.style) for r in docs.rows.orderBy("doc_id", "part", "seq").collect()]
    assert found == [(1, "document", 0, "paragraph", "Dear Ann: 2,50 PLN {Loop}!!!!! {Gone}", None, "S"), (1, "document", 1, "table_row", "", ["h"], "TableGrid"), (1, "document", 2, "table_row", "", ["2,50 PLN"], "TableGrid"), (1, "document", 3, "paragraph", "see ", None, "S"), (1, "document", 4, "image", "", None, ""), (1, "header1", 0, "paragraph", "Ann", None, None), (2, "document", 0, "paragraph", "{Name}", None, None)]


def test_normalised_twice_is_once(spark):
    packages = spark.createDataFrame([("a", bytearray(sink.document_bytes(document("T"))))], "path string, content binary")
    once = package.unpack(packages, "elements", "runs", "styles")
    tables = [package.rows_of(once, k).withColumnRenamed("path", "doc_id") for k in ("elements", "runs", "styles")]
    out = {k: scratch.written(v, k) for k, v in normalize.normalised(*tables).items()}
    again = normalize.normalised(out["elements"], out["runs"], out["styles"])
    canon = lambda df: sorted(str([(c, sorted(v.items()) if isinstance(v, dict) else v) for c, v in sorted(r.asDict().items())]) for r in df.collect())
    assert all(canon(out[k]) == canon(again[k]) for k in out)
    text = lambda runs: runs.groupBy("part", "seq", "place").agg(F.array_join(F.array_sort(F.collect_list(F.struct("run", "text")))["text"], "").alias("t")).orderBy("part", "seq", "place").collect()
    assert [r for r in text(tables[1]) if r.t] == [r for r in text(out["runs"]) if r.t]
    assert {r.style for r in out["runs"].collect()} >= {"Run1"} and out["runs"].filter("bold OR italic").count() == 0


def greedy(text: str, limit: int, width) -> list[str]:
    lines, line = [], ""
    for word in text.split():
        candidate = f"{line} {word}" if line else word
        if not line or width(candidate) <= limit:
            line = candidate
        else:
            lines.append(line)
            line = word
    return lines + [line] if line or not lines else lines


def test_lines_are_brute_force(spark):
    rng = random.Random(2)
    texts = ["", " \t ", "one", "x" * 90, " ".join("".join(rng.choice("ilmwabc é😀") for _ in range(rng.randrange(1, 30))) for _ in range(400)), "a  b\nc d"]
    font = {"i": 250, "l": 250, "m": 900, " ": 300}
    table = linebreak.widths_of(font)
    width = lambda s: int(sum(table[min(ord(c), 65535)] for c in s))
    rows = linebreak.broken(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string"), 120.0, 10.0, font).orderBy("doc_id", "line").collect()
    for i, text in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert [r.text for r in own] == greedy(text, 12_000, width)
        assert all(text[r.start : r.end].split() == r.text.split() and abs(r.width - width(r.text) / 100) < 1e-9 for r in own)
    assert not [r for r in rows if r.doc_id == 99]


def test_inherited_is_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 9)
        based = {f"s{i}": rng.choice([None, "gone", *(f"s{j}" for j in range(n))]) for i in range(n)}
        own = {s: {f"k{rng.randrange(4)}": f"{s}{k}" for k in range(2)} for s in based}
        found = styles.inherited(based, own)
        for s in based:
            chain, at = [], s
            while at in based and at not in chain:
                chain.append(at)
                at = based[at]
            want: dict = {}
            for a in reversed(chain):
                want |= own[a]
            assert found[s] == want


def test_rules_that_were_wrong(spark):
    row = spark.createDataFrame([(1, 0, "İstanbul abc ABC ẞ abc")], "doc_id long, seq int, text string")
    assert [(r.start, r.end) for r in elements.search(row, "Abc").orderBy("start").collect()] == [(9, 12), (13, 16), (19, 22)]
    schema = "doc_id long, style_id string, based_on string"
    merged = merging.styles_merged(spark.createDataFrame([(1, "A", None)], schema), spark.createDataFrame([(1, "A", None), (1, "C", "A"), (2, "A", None), (2, "C", "A")], schema))
    assert {(r.doc_id, r.style_id, r.based_on) for r in merged.collect()} == {(1, "A", None), (1, "A_merged", None), (1, "C", "A_merged"), (2, "A", None), (2, "C", "A")}
    used = spark.createDataFrame([(1, "X"), (2, "X")], "doc_id long, style string")
    assert [r.doc_id for r in styles.dangling(used, "style", spark.createDataFrame([(2, "X")], "doc_id long, style_id string"), "style_id").collect()] == [1]


def test_notes_take_room_where_their_references_are():
    """Random blocks: every line once and in order, every note on its reference's page, no page over its height unless one line alone is, and no page left while its next lines would have fitted."""
    from lamina.operators import assembly

    rng = random.Random(9)
    for _ in range(150):
        usable, gap, counted, least = 100.0, 4.0, rng.choice([1, 2]), rng.choice([1, 2])
        blocks = []
        for i in range(rng.randrange(1, 12)):
            lines = rng.randrange(1, 14)
            notes = [{"line": rng.randrange(lines), "id": f"{i}-{k}", "h": float(rng.choice([6, 10, 18]))} for k in range(rng.choice([0, 0, 1, 2]))]
            blocks.append({"seq": i, "kind": rng.choice(["paragraph", "table"]), "lines": lines, "line_h": 10.0, "before": 0.0, "after": 0.0, "break_before": False, "break_after": False, "keep": False, "notes": notes})
        out = assembly.assemble_noted(blocks, usable, least, counted, gap)
        body = [r for r in out if r["kind"] != "footnote"]
        page_of = {}
        for b in blocks:
            own = [r for r in body if r["seq"] == b["seq"]]
            assert [r["first_line"] for r in own] == [sum(x["n_lines"] for x in own[:k]) for k in range(len(own))] and sum(r["n_lines"] for r in own) == b["lines"]
            for r in own:
                page_of |= {(b["seq"], r["first_line"] + k): r["page"] for k in range(r["n_lines"])}
            for x in b["notes"]:
                assert [r["page"] for r in out if r["note"] == x["id"]] == [page_of[b["seq"], x["line"]]]
        flat = [(b["seq"], k, sum(x["h"] for x in b["notes"] if x["line"] == k)) for b in blocks for k in range(b["lines"])]
        pages = {p: [f for f in flat if page_of[f[:2]] == p] for p in set(page_of.values())}
        full = lambda own: 10.0 * len(own) + counted * (sum(h for *_, h in own) + (gap if any(h for *_, h in own) else 0.0))
        for p, own in pages.items():
            assert full(own) <= usable + 1e-6 or len(own) == 1
            if p + 1 in pages and least == 1:
                assert full(own + pages[p + 1][:1]) > usable
        assert [page_of[f[:2]] for f in flat] == sorted(page_of[f[:2]] for f in flat)


def test_chains_and_resolved_are_joins_and_brute_force(spark):
    """Cycles, missing bases, a base of many and one long chain; Spark walks them, so that no document has to fit a Python worker."""
    rng = random.Random(6)
    own = {(d, f"s{i}"): (rng.choice([None, f"s{rng.randrange(14)}"]), {f"k{rng.randrange(3)}": f"{d}-{i}"} if rng.random() < 0.8 else {}) for d in range(4) for i in range(11)}
    own |= {(9, f"s{i}"): (f"s{i - 1}" if i else None, {f"k{i}": "x"} if i % 50 == 0 else {}) for i in range(140)}
    own |= {(8, f"s{i}"): (f"s{(i + 1) % 70}", {"k": str(i)}) for i in range(80)}
    rows = spark.createDataFrame([(d, s, b, p) for (d, s), (b, p) in own.items()], "doc_id long, style_id string, based_on string, properties map<string,string>")
    chains, resolved = styles.chains(rows), styles.resolved(rows)
    assert not any("Python" in df._jdf.queryExecution().toString() or "InPandas" in df._jdf.queryExecution().toString() for df in (chains, resolved))
    want = set()
    for d, s in own:
        at, seen = s, []
        while (d, at) in own and at not in seen:
            want.add((d, s, at, len(seen)))
            seen.append(at)
            at = own[d, at][0]
    found = chains.collect()
    assert len(found) == len(want) and {(r.doc_id, r.style_id, r.ancestor, r.depth) for r in found} == want
    whole = {d: styles.inherited({s: b for (e, s), (b, _) in own.items() if e == d}, {s: p for (e, s), (_, p) in own.items() if e == d}) for d, _ in own}
    got = resolved.collect()
    assert {(r.doc_id, r.style_id): r.properties for r in got} == {(d, s): p for d, ps in whole.items() for s, p in ps.items() if p} and len(got) == len({(r.doc_id, r.style_id) for r in got})


@pytest.mark.parametrize("name", ["package_styles", "package_numbering", "package_sections", "package_damage", "xml_texts"])
def test_packages_of_one_small_file_are_many_tasks(spark, monkeypatch, name):
    """The table of parts is one file of one row group; its packages aren't one task's work."""
    seen = []
    write = sink.write_documents
    monkeypatch.setattr(sink, "write_documents", lambda documents, *args, **kw: seen.append(documents) or write(documents, *args, **kw))
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert (seen or [out])[0].rdd.getNumPartitions() >= 4


def test_stored_entries_are_as_zipfile_makes_them():
    own = {"[Content_Types].xml": b"<x/>", "word/\u00e4.bin": bytes(range(256)), "empty": b""}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in own.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    assert sink.zipped(own) == out.getvalue()
    assert {n: zipfile.ZipFile(io.BytesIO(sink.zipped(own))).read(n) for n in own} == own


def test_normalised_makes_its_rows_once(spark):
    """Elements, definitions and runs come of tables that are there; the source isn't read again for each of them."""
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("id % 5 AS doc_id", "'document' AS part", "cast(id AS int) AS seq", "'paragraph' AS kind", "'Base' AS style", "map('jc', if(id % 2 = 0, 'left', 'right')) AS properties")
    rows = rows.mapInArrow(counted, rows.schema)
    own = spark.range(5).selectExpr("id AS doc_id", "'Base' AS style_id", "'paragraph' AS type", "'Base' AS name", "cast(NULL AS string) AS based_on", "map('jc', 'left') AS properties")
    none = [f"cast(NULL AS string) AS {c}" for c in (*normalize.LOOK, "field", "note")]
    runs = spark.range(40).selectExpr("id % 5 AS doc_id", "'document' AS part", "cast(id AS int) AS seq", "'x' AS place", "0 AS run", "'t' AS text", *(f"cast(NULL AS boolean) AS {c}" for c in normalize.SWITCHES), *none)
    out = normalize.normalised(rows, runs, own)
    before = counter.value
    made = [r for r in out["styles"].collect() if r.style_id != "Base"]
    assert {(r.doc_id, r.style_id, r.based_on, r.properties["jc"]) for r in made} == {(d, "Paragraph1", "Base", "right") for d in range(5)} and len(made) == 5
    assert counter.value == before


def test_copies_write_one_table_however_long_the_ways(spark, monkeypatch):
    """A chain of twelve parts is walked within its document's row: the only table is the result."""
    names, real = [], parts.scratch.written
    monkeypatch.setattr(parts.scratch, "written", lambda df, name, at=None: names.append(name) or real(df, name, at))
    chain = [f"word/c{i}.xml" for i in range(12)]
    source = spark.createDataFrame([(d, p, "s") for d in (1, 2) for p in ("word/document.xml", *chain)], "doc_id long, part string, digest string")
    target = spark.createDataFrame([(1, "word/c3.xml", "t")], "doc_id long, part string, digest string")
    rels = spark.createDataFrame([(d, a, "rId1", "x", "/" + b, None) for d in (1, 2) for a, b in zip(("word/document.xml", *chain), chain)], RELS)
    used = spark.createDataFrame([(1, "word/document.xml", "rId1"), (2, "word/document.xml", "rId1")], "doc_id long, part string, rel_id string")
    found = parts.copied(target, spark.createDataFrame([], RELS), source, rels, used)
    assert {(r.doc_id, r.part, r.new_part) for r in found.parts.filter("copied").collect()} == {(d, p, "word/c12.xml" if (d, p) == (1, "word/c3.xml") else p) for d in (1, 2) for p in chain}
    assert found.relationships.count() == 24 and found.missing.isEmpty() and names == ["copies"]


def test_checks_of_one_partition_are_many_tasks(spark):
    """Rows that compress well, or come from one small file, aren't put together in one task however many they are."""
    from lamina.operators import checks, reports

    docs = spark.range(400, numPartitions=1).withColumnRenamed("id", "doc_id")
    types = docs.selectExpr("doc_id", "'*.xml' AS name", "'application/xml' AS content_type")
    copies = docs.selectExpr("doc_id", "'a.xml' AS part", "'b.xml' AS new_part", "true AS copied")
    own = types.unionByName(docs.selectExpr("doc_id", "'a.xml' AS name", "if(doc_id % 2 = 0, 'chart', NULL) AS content_type")).coalesce(1)
    found = parts.united_types(types, own, copies)
    assert {(r.doc_id, r.name, r.content_type) for r in found.collect()} == {(d, "*.xml", "application/xml") for d in range(400)} | {(d, "b.xml", "chart") for d in range(0, 400, 2)}
    there = docs.selectExpr("doc_id", "'word/document.xml' AS part", "'x' AS content_type")
    rels = docs.selectExpr("doc_id + 1 AS doc_id", "'word/document.xml' AS source", "'rId1' AS rel_id", "'document.xml' AS target", "cast(NULL AS string) AS target_mode")
    issues = reports.package_issues(there, rels)
    assert [(r.doc_id, r.rule) for r in issues.filter("doc_id = 400").collect()] == [(400, "broken_target")] and issues.filter("rule = 'broken_target'").count() == 1 and issues.filter("doc_id = 0").count() == 8
    left = checks.dangling(docs.selectExpr("doc_id", "'s' AS style_id", "if(doc_id % 2 = 0, 's', 'gone') AS based_on"), "based_on", docs.selectExpr("doc_id", "'s' AS style_id"), "style_id", "missing_base", "style", "style_id")
    assert {r.doc_id for r in left.collect()} == set(range(1, 400, 2))
    for frame in (found, issues, left):
        assert frame.select(F.spark_partition_id()).distinct().count() > 1


def test_numbering_is_dealt_out_once(spark):
    """Levels that are there twice are no difference, and neither collected levels nor a join of instances lies between them and their list."""
    schema = "doc_id long, num_id string, level int, format string, text string, start int, properties map<string,string>"
    target = spark.createDataFrame([(1, "1", 0, "decimal", "%1.", 1, {"a": "1"}), (1, "1", 0, "decimal", "%1.", 1, {"a": "1"}), (1, "1", 1, "bullet", "o", 1, {})], schema)
    source = spark.createDataFrame([(1, "1", 1, "bullet", "o", None, None), (1, "1", 0, "decimal", "%1.", 1, {"a": "1"}), (1, "2", 0, "decimal", "%1.", 1, {"a": "1"})], schema)
    found = full_merge.numbering_merged(target, source, full_merge.numbered_on(target, source, "num_id"))
    assert sorted((r.num_id, r.level, r.abstract_id) for r in found.collect()) == [("1", 0, 0), ("1", 0, 0), ("1", 1, 0), ("2", 0, 0), ("2", 1, 0), ("3", 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and plan.count("Join ") == 2


def test_pages_read_their_blocks_once(spark):
    from lamina.operators import assembly

    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    blocks = spark.range(60).selectExpr("id % 6 AS doc_id", "id AS seq", "'paragraph' AS kind", "4 AS lines", "10.0D AS line_h", "0.0D AS before", "0.0D AS after", "false AS break_before", "false AS break_after", "false AS keep", "cast(NULL AS array<struct<line: int, id: string, h: double>>) AS notes")
    ends = spark.createDataFrame([(1, 0, 7, 10.0), (1, 1, 25, 10.0), (9, 0, 1, 10.0)], "doc_id long, seq long, lines int, line_h double")
    headers, marks = spark.createDataFrame([(1, "default", "h")], "doc_id long, variant string, text string"), spark.createDataFrame([(9, "m")], "doc_id long, text string")
    rows = assembly.whole_pages(blocks.mapInArrow(counted, blocks.schema), headers, marks, ends, usable=100.0).collect()
    assert counter.value == 60
    assert sorted((r.doc_id, r.page, r.seq, r.first_line, r.n_lines, r.y, r.h) for r in rows if r.layer == "endnotes") == [(1, 5, 0, 0, 7, 0.0, 70.0), (1, 5, 1, 0, 3, 70.0, 30.0), (1, 6, 1, 3, 10, 0.0, 100.0), (1, 7, 1, 13, 10, 0.0, 100.0), (1, 8, 1, 23, 2, 0.0, 20.0), (9, 1, 0, 0, 1, 0.0, 10.0)]
    assert sorted(r.page for r in rows if r.layer == "header") == list(range(1, 9)) and [(r.doc_id, r.page) for r in rows if r.layer == "watermark"] == [(9, 1)]
    assert sorted((r.seq, r.page) for r in rows if r.layer == "body" and r.doc_id == 1 and r.first_line == 0) == [(1 + 6 * i, i * 4 // 10 + 1) for i in range(10)]


def test_full_merge_broadcasts_nothing(spark):
    """A broadcast passes a table whole through the driver, and tables of documents are much larger there than in their files."""
    from lamina.plans import registry

    plan = registry.QUERIES["full_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_sections_fill_their_texts_once(spark):
    """Markers and rows come of filled texts that are there: the rows aren't read again for each of them."""
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    rows = spark.range(8).selectExpr("id div 4 AS doc_id", "cast(id % 4 AS int) AS seq", "'paragraph' AS kind", "element_at(array('{A}', 'in {A}', '{{END_S}}', 'end'), cast(id % 4 AS int) + 1) AS text").mapInArrow(counted, "doc_id long, seq int, kind string, text string")
    out = fill.filled(rows, spark.range(2).withColumnRenamed("id", "doc_id"), {"A": "'{{START_S}}'"}, {}, {"S": "doc_id = 1"})
    assert sorted((r.doc_id, r.seq, r.text) for r in out.collect()) == [(0, 3, "end"), (1, 0, ""), (1, 1, "in "), (1, 2, ""), (1, 3, "end")]
    assert counter.value == 8


def test_runs_are_united_in_one_shuffle(spark):
    """A paragraph's runs are one row between the scan and the united runs: no window, no join of single runs; a style's look, fields and notes part neighbours."""
    blank = [f"cast(NULL AS {'boolean' if c in normalize.SWITCHES else 'string'}) AS {c}" for c in (*normalize.SWITCHES, *normalize.LOOK) if c != "bold"]
    runs = spark.range(12).selectExpr("id % 2 AS doc_id", "'document' AS part", "cast(id % 1 AS int) AS seq", "'x' AS place", "cast(id div 2 AS int) AS run", "if(id div 2 = 3, '', concat('t', id div 2)) AS text", "if(id div 2 < 2, true, NULL) AS bold", *blank, "if(id div 2 = 4, 'PAGE', NULL) AS field", "cast(NULL AS string) AS note")
    whole = normalize.united(runs)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    assert sorted((r.doc_id, r.run, r.text, r.bold, r.field) for r in whole.collect()) == sorted((d, *r) for d in (0, 1) for r in ((0, "t0t1", True, None), (1, "t2", None, None), (2, "t4", None, "PAGE"), (3, "t5", None, None)))
    owners = spark.createDataFrame([(0, "document", 0, {"b": "true"})], "doc_id long, part string, seq int, _theirs map<string,string>")
    assert [r.text for r in normalize.united(runs, owners=owners).filter("doc_id = 0").orderBy("run").collect()] == ["t0t1t2", "t4", "t5"]


def test_names_of_parts_as_before(spark):
    """Paths with nothing to resolve go the short way, and texts without a number are never cast."""
    names = [("word/document.xml", "media/a.png", "word/media/a.png"), ("word/charts/c.xml", "../media/./a.png", "word/media/a.png"), ("", "word//document.xml", "word/document.xml"), ("a/b.xml", "/x/../y.xml", "y.xml"), ("b.xml", "c.xml", "c.xml"), ("a/b.xml", "..", ""), ("a/b.xml", "c./d", "a/c./d"), ("a/b.xml", "../../../d", "d"), ("a/b.xml", "", "a"), ("a/b", None, None), ("a/", "c", "a/c")]
    rows = spark.createDataFrame(names, "source string, target string, want string").select("want", parts.part_name().alias("found"))
    assert [r for r in rows.collect() if r.want != r.found] == []
    numbers = [("rId12", 12), ("rId", None), ("", None), (None, None), ("word/media/image7.png", 7), ("x7y.png", None), ("a9.b8.xml", 8), ("9" * 30, None)]
    found = spark.createDataFrame(numbers, "name string, want long").select("want", parts.number_of("name").alias("found"))
    assert [r for r in found.collect() if r.want != r.found] == []
    assert "number IS NULL" not in parts._number("x") and "if(x = ''" in parts._number("x")
