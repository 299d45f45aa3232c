"""Command line: ``python -m lamina convert|info|pipeline|queries|query|version``; runs under spark-submit as well."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lamina
from lamina.document import Documents

FORMATS = ("text", "json", "nested_json", "html", "editable_html", "docx", "pdf", "xlsx")


def opened(spark: SparkSession, source: str, kind: str) -> Documents:
    """Packages below a path, or tables of texts or HTML in Parquet (doc_id, text; page_id, html)."""
    if kind == "packages":
        return Documents.open(spark, source)
    return Documents.from_text(spark.read.parquet(source)) if kind == "texts" else Documents.from_html(spark.read.parquet(source))


def converted(documents: Documents, to: str) -> DataFrame:
    """One row a document: its key and the text or bytes of the format."""
    return {
        "text": documents.to_text, "json": documents.to_json, "nested_json": documents.to_nested_json, "html": documents.to_html, "editable_html": documents.to_editable_html,
        "docx": documents.to_packages, "pdf": documents.to_pdf, "xlsx": documents.to_workbooks,
    }[to]()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamina")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("convert", "write documents in another format, as Parquet"), ("info", "statistics of each document"), ("pipeline", "assemble pages and report what is on them")):
        command = commands.add_parser(name, help=text)
        command.add_argument("source")
        command.add_argument("--kind", choices=("packages", "texts", "html"), default="packages")
        if name != "info":
            command.add_argument("target")
        if name == "convert":
            command.add_argument("--to", choices=FORMATS, required=True)
    commands.add_parser("queries", help="names of the queries")
    command = commands.add_parser("query", help="run a query over a folder of tables")
    command.add_argument("name")
    command.add_argument("tables")
    command.add_argument("target", nargs="?")
    commands.add_parser("version")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    if given.command == "version":
        print(lamina.__version__)
        return 0
    from lamina.plans import registry

    if given.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if given.command == "query" and given.name not in registry.QUERIES:
        print(f"no query called {given.name}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("lamina").getOrCreate()
    if given.command == "query":
        found = registry.QUERIES[given.name](spark, given.tables)
        found.write.parquet(given.target) if given.target else found.show(truncate=False)
        return 0
    documents = opened(spark, given.source, given.kind)
    if given.command == "info":
        documents.structure().show(truncate=False)
    elif given.command == "convert":
        converted(documents, given.to).write.parquet(given.target)
    else:
        placed = documents.assembled()
        placed.write.parquet(given.target)
        spark.read.parquet(given.target).groupBy("doc_id").agg(F.max("page").alias("pages"), F.count("*").alias("pieces")).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
