"""The data source: filters that reach the reader, pruned columns, damaged files, writes that commit or leave nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.sinks import package as sink
from lamina.sources import datasource, package


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    place = tmp_path_factory.mktemp("packages")
    for i in range(7):
        (place / f"d{i}.docx").write_bytes(sink.document_bytes({"blocks": [{"style": "H", "runs": [{"text": f"text {i}", "bold": i % 2 == 0}]}]}))
    (place / "broken.docx").write_bytes(b"no package")
    (place / "other.txt").write_bytes(b"x")
    return f"file://{place}"


def test_reads_what_the_scan_reads(spark, folder):
    packages = package.read_packages(spark, folder + "/*.docx")
    for kind in ("elements", "runs", "parts", "relationships"):
        ours = spark.read.format("lamina").option("kind", kind).load(folder)
        theirs = package.scan(packages, kind)
        name = F.substring_index("path", "/", -1).alias("path")
        canon = lambda df: sorted(str(r) for r in df.select(name, *(c for c in df.columns if c not in ("path", "properties"))).collect())
        assert canon(ours) == canon(theirs) and ours.columns == theirs.columns
    errors = spark.read.format("lamina").option("kind", "errors").load(folder).collect()
    assert [(r.path.rpartition("/")[2], r.kind) for r in errors] == [("broken.docx", "package")]


def test_filters_and_columns_reach_the_reader(spark, folder):
    pruned = spark.read.format("lamina").schema("path string, text string").load(folder)
    assert sorted(r.text for r in pruned.collect()) == [f"text {i}" for i in range(7)]
    one = spark.read.format("lamina").load(folder).filter(F.col("path").endswith("x") & (F.col("path") == f"{folder}/d3.docx"))
    assert [r.text for r in one.collect()] == ["text 3"] and one.rdd.getNumPartitions() == 1
    reader = datasource.PackageReader(one.schema, {"path": folder, "taskBytes": "1"})
    assert len(reader.partitions()) == 8
    left = list(reader.pushFilters([datasource.EqualTo(("path",), f"{folder}/d3.docx"), datasource.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{folder}/d3.docx"]]
    part = spark.read.format("lamina").option("kind", "parts").load(folder).filter("part = 'word/document.xml'")
    assert part.count() == 7 and {r.content_type for r in part.select("content_type").collect()} == {sink.PART_TYPES["officeDocument"]}


def test_writes_commit_or_leave_nothing(spark, folder, tmp_path):
    rows = spark.createDataFrame([(i, [{"runs": [{"text": f"t{i}"}]}]) for i in range(5)], "doc_id long, blocks array<struct<runs: array<struct<text: string>>>>")
    made = sink.write_documents(rows).select(F.col("doc_id").cast("string").alias("name"), "content")
    made.write.format("lamina").mode("append").save(f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{i}.docx" for i in range(5)]
    assert sorted(r.text for r in spark.read.format("lamina").load(f"file://{tmp_path}").collect()) == [f"t{i}" for i in range(5)]
    with pytest.raises(Exception, match="no content|one name"):
        made.withColumn("content", F.when(F.col("name") != "3", F.col("content"))).withColumn("name", F.concat(F.lit("x"), "name")).write.format("lamina").mode("append").save(f"file://{tmp_path}")
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("x")]
