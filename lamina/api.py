"""One-call helpers: open, fill, render. Each is a line over ``Documents``; nothing runs before its result is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.document import Documents

#: Format -> what renders documents to it, (doc_id, text or content); ``register_format`` adds to it.
FORMATS: dict[str, Callable[[Documents], DataFrame]] = {
    "text": Documents.to_text, "json": Documents.to_json, "nested_json": Documents.to_nested_json, "html": Documents.to_html, "editable_html": Documents.to_editable_html,
    "pdf": Documents.to_pdf, "xlsx": Documents.to_workbooks, "docx": Documents.to_packages,
}


def register_format(name: str, render: Callable[[Documents], DataFrame]) -> None:
    FORMATS[name.lower()] = render


def open_documents(spark: SparkSession, path: str) -> Documents:
    return Documents.open(spark, path)


def render(documents: Documents, form: str) -> DataFrame:
    """The documents in a format by name."""
    if form.lower() not in FORMATS:
        raise KeyError(f"no format called {form}; there are: {', '.join(sorted(FORMATS))}")
    return FORMATS[form.lower()](documents)


def fill_template(spark: SparkSession, path: str, data: DataFrame, **values: str) -> Documents:
    return open_documents(spark, path).fill(data, **values)


def convert(spark: SparkSession, path: str, form: str) -> DataFrame:
    return render(open_documents(spark, path), form)


def merge_documents(first: Documents, second: Documents) -> Documents:
    return first.merge(second)
