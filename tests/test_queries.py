"""Every query with an oracle against DuckDB on the smallest tables; the others against rules in Python."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lamina.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "?") in "iuf":
        return f"{float(x):.9g}"
    return str(x)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_oracle(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def wrap(text: str, width: int) -> str:
    lines, line, used = [], [], 0
    for w in text.split():
        if used + len(w) + 1 <= width:
            line.append(w)
            used += len(w) + 1
        elif line:
            lines.append(" ".join(line))
            line, used = [w], len(w)
        else:
            lines.append(w)
            used = 0
    return "\n".join(lines + [" ".join(line)] * bool(line))


def test_wrap(spark):
    from lamina.operators import elements

    texts = ["a bb ccc dddd", "averylongwordthatexceeds it", "", "one", " lead  and   gaps ", "x" * 30 + " y"]
    rows = elements.wrapped(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, seq int, text string"), 10).collect()
    assert {r.doc_id: r.wrapped for r in rows} == {i: wrap(t, 10) if t else t for i, t in enumerate(texts)}


def test_pagination_is_monotone_and_opens_pages(spark):
    from lamina.operators import elements

    blocks = spark.createDataFrame([(1, 0, 100.0), (1, 1, 100.0), (1, 2, 100.0), (1, 3, 300.0), (2, 0, 300.0)], "doc_id long, seq int, h double")
    found = {(r.doc_id, r.seq): (r.page, round(r.y, 3)) for r in elements.paginated(blocks).collect()}
    assert found == {(1, 0): (1, 25.4), (1, 1): (1, 125.4), (1, 2): (2, 25.4), (1, 3): (3, 25.4), (2, 0): (2, 25.4)}


def test_html_rules():
    from lamina.sources.html import scan

    rows = scan("<p>One <b>two</b></p><ul><li>x<li>y</li></ul><table><tr><th>H</th></tr><tr><td>a</td></tr></table><img src='i.png'>")
    assert [(r["kind"], r["text"]) for r in rows] == [("paragraph", "One two"), ("paragraph", ""), ("paragraph", "y"), ("cell", "H"), ("cell", "a"), ("image", "")]
    assert rows[0]["runs"][1]["bold"] and rows[2]["list_format"] == "bullet" and rows[3]["is_header"] and not rows[4]["is_header"]
    assert scan(None) == []


def test_package_scans(spark):
    from lamina.sinks.package import NS, package_bytes
    from lamina.sources import package

    styles = f'<w:styles xmlns:w="{NS}"><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="Heading 1"/><w:basedOn w:val="N"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    notes = f'<w:footnotes xmlns:w="{NS}"><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    data = package_bytes([("a < b", "H1"), ("", None)], "T", {"word/styles.xml": styles, "word/footnotes.xml": notes})
    df = spark.createDataFrame([("p", bytearray(data)), ("broken", bytearray(b"no"))], "path string, content binary")
    found = package.scan(df, "elements").orderBy("seq").collect()
    assert [(r.text, r.style) for r in found] == [("a < b", "H1"), ("", None)]
    style = package.scan(df, "styles").first()
    assert (style.name, style.based_on, style.properties) == ("Heading 1", "N", {"b": "true"})
    assert [r.text for r in package.scan(df, "notes").collect()] == ["note"]
    assert package.scan(df, "relationships").first().target == "word/document.xml"
    assert {r.name: r.value for r in package.scan(df, "properties").collect()}["title"] == "T"
    assert package.scan(df, "sections").first().width == 11906
    assert package.scan(df, "parts").filter("content_type IS NULL").count() == 0
    assert package.scan(df, "settings").count() == 2
