from __future__ import annotations

from pyspark.sql import functions as F

from lamina.document import Documents


def test_text_to_packages_and_back(spark, tmp_path):
    table = spark.createDataFrame([(1, "Dear {{ TEXT:Name }},\nyou owe {Sum}  now"), (2, "Dear {Name}\n"), (3, None)], "doc_id long, text string")
    docs = Documents.from_text(table)
    assert {(r.doc_id, r.name): (r.type, r.n) for r in docs.placeholders().collect()} == {(1, "TEXT:Name"): ("text", 1), (1, "Sum"): ("text", 1), (2, "Name"): ("text", 1)}
    data = spark.createDataFrame([(1, "Ann", 5), (2, None, 7)], "doc_id long, name string, total int")
    filled = docs.fill(data, **{"TEXT:Name": "name", "Sum": "total"}).normalized()
    assert filled.changes == ("fill", "normalize")
    assert {r.doc_id: r.text for r in filled.text().collect()} == {1: "Dear Ann,\nyou owe 5 now", 2: "Dear {Name}"}
    for r in filled.to_packages().collect():
        (tmp_path / f"{r.doc_id}.docx").write_bytes(r.content)
    again = Documents.open(spark, f"file://{tmp_path}/*.docx")
    assert sorted(r.text for r in again.text().collect()) == ["Dear Ann,\nyou owe 5 now", "Dear {Name}"]
    assert again.scan("parts").count() > 0 and again.search("OWE").first().start == 4


def test_merge_and_sinks(spark):
    a = Documents.from_text(spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string"))
    groups = spark.createDataFrame([(1, 7), (2, 7)], "doc_id long, g long")
    merged = a.merge_groups(groups, "g")
    assert [(r.seq, r.kind, r.text) for r in merged.rows.orderBy("seq").collect()] == [(0, "paragraph", "a"), (1, "paragraph", "b"), (2, "page_break", ""), (3, "paragraph", "c")]
    assert {r.doc_id: r.text for r in a.merge(a).text().collect()} == {1: "a\nb\na\nb", 2: "c\nc"}
    assert {r.doc_id: r.html for r in a.replace("a", "<x>").to_html().collect()}[1] == "<p>&lt;x&gt;</p>\n<p>b</p>"
    assert a.to_text(F.lit("T")).filter("doc_id = 2").first().text == "T\n=\n\nc\n"
    page = Documents.from_html(spark.createDataFrame([(1, "<p>x</p><ul><li>y</li></ul>")], "page_id long, html string"))
    assert [r.text for r in page.rows.orderBy("seq").collect()] == ["x", "y"]
    assert '"document_type":"flat"' in a.to_json().first().json
