"""Documents as one object: a thin facade over the DataFrames of elements, styles and properties.

Nothing runs before a DataFrame that a method returns is used. Methods that change documents return new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import scratch
from lamina.functions import text as T
from lamina.operators import assembly, elements, fill, full_merge, merging, normalize, styles
from lamina.sinks import package as package_sink
from lamina.sinks import pdf as pdf_sink
from lamina.sinks import text as text_sink
from lamina.sinks import workbook as workbook_sink
from lamina.sources import html, package


class Documents:
    """Elements (doc_id, seq, kind, text, ...) of any number of documents, with the packages they came from, if any."""

    def __init__(self, rows: DataFrame, packages: DataFrame | None = None, changes: tuple[str, ...] = ()):
        self.rows, self.packages, self.changes = rows, packages, changes

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Documents:
        """All packages below a path or glob; the path of each is its doc_id."""
        packages = package.read_packages(spark, path)
        return cls(package.scan(packages, "elements").withColumnRenamed("path", "doc_id"), packages)

    @classmethod
    def from_text(cls, table: DataFrame, key: str = "doc_id", text: str = "text") -> Documents:
        """A paragraph a line."""
        lines = elements.paragraphs(table.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
        return cls(lines.withColumn("kind", F.lit("paragraph")))

    @classmethod
    def from_html(cls, pages: DataFrame, key: str = "page_id", source: str = "html") -> Documents:
        return cls(html.scan_pages(pages, key, source).withColumnRenamed(key, "doc_id"))

    def _with(self, rows: DataFrame, change: str) -> Documents:
        return Documents(rows, self.packages, (*self.changes, change))

    def scan(self, what: str) -> DataFrame:
        """Rows of another part of the packages: styles, notes, comments, relationships, properties, sections, settings and the like."""
        if self.packages is None:
            raise ValueError("these documents don't come from packages")
        return package.scan(self.packages, what).withColumnRenamed("path", "doc_id")

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.rows.filter(F.col("kind").isin(*kinds))

    def text(self) -> DataFrame:
        return elements.joined_text(self.rows)

    def search(self, needle: str, **options) -> DataFrame:
        return elements.search(self.rows, needle, **options)

    def structure(self) -> DataFrame:
        return elements.structure(self.rows)

    def placeholders(self) -> DataFrame:
        """name, type and number of the placeholders of each document."""
        return styles.placeholders(self.rows.select("doc_id", "text")).groupBy("doc_id", "name", "type").agg(F.count("*").alias("n"))

    def replace(self, needle: str, by: str, case_sensitive: bool = True) -> Documents:
        return self._with(elements.replace(self.rows, needle, by, case_sensitive).drop("n"), f"replace {needle}")

    def fill(self, data: DataFrame, blocks: dict[str, str] | None = None, sections: dict[str, str] | None = None, **values: str) -> Documents:
        """Placeholders filled from one row of ``data`` (doc_id, ...) a document; values are SQL expressions over it by key, shown as the key's type asks.

        ``blocks`` (key -> ``fill.table_block``, ``list_block``, ``image_block``, ``watermark_block``) come in place of their placeholders; ``sections`` (name -> condition) show or hide.
        Keys without a value, and documents without a row or with a null value, keep their placeholders.
        """
        return self._with(fill.filled(self.rows, data, values, blocks, sections), "fill")

    def merge(self, other: Documents, prepend: bool = False) -> Documents:
        """Each document with the other's of the same doc_id behind or before it."""
        return self._with(elements.merged(self.rows, other.rows, prepend), "merge")

    def merge_full(self, other: Documents, page_break: bool = True) -> dict[str, DataFrame]:
        """The tables of whole merged packages by kind (elements, runs, styles, numbering, notes, comments, sections, relationships, parts): ``full_merge.merged`` of both sides' packages by their path's last name."""
        if self.packages is None or other.packages is None:
            raise ValueError("these documents don't come from packages")
        named = lambda p: p.withColumn("doc_id", F.substring_index("path", "/", -1)).select("doc_id", "content")
        return full_merge.merged(full_merge.tables_of(named(self.packages), "doc_id"), full_merge.tables_of(named(other.packages), "doc_id"), page_break=page_break)

    def merge_groups(self, groups: DataFrame, group: str) -> Documents:
        """One document a group of (doc_id, group), a page break between its members."""
        rows = merging.merged_in_order(self.rows.select("doc_id", "seq", "kind", "text").join(groups.select("doc_id", group), "doc_id"), group)
        return self._with(rows.drop("doc_id").withColumnRenamed(group, "doc_id"), "merge_groups")

    def normalized(self) -> Documents:
        """Runs of blanks become one."""
        return self._with(self.rows.withColumn("text", F.expr(T.collapse_spaces("text"))), "normalize")

    def normalised_tables(self) -> dict[str, DataFrame]:
        """elements, runs and styles of the packages with clean values, united runs and styles in place of local formatting (``normalize.normalised``)."""
        if self.packages is None:
            raise ValueError("these documents don't come from packages")
        once = scratch.written(package.unpack(self.packages, "runs", "styles"), "packages")
        runs, styles = (package.rows_of(once, kind).withColumnRenamed("path", "doc_id") for kind in ("runs", "styles"))
        return normalize.normalised(self.rows, runs, styles)

    def to_text(self, title: Column | None = None) -> DataFrame:
        found = text_sink.plain(self.rows, title if title is not None else F.col("doc_id").cast("string"))
        return found.withColumn("text", F.expr(text_sink.finished("text")))

    def to_json(self) -> DataFrame:
        return text_sink.flat_json(self.rows)

    def to_html(self) -> DataFrame:
        return text_sink.html(self.rows)

    def _body(self) -> DataFrame:
        """Elements without headers, footers and the links that paragraphs hold anyway."""
        rows = self.rows.filter("part = 'document'") if "part" in self.rows.columns else self.rows
        return rows.filter("kind <> 'hyperlink'")

    def to_nested_json(self) -> DataFrame:
        """Tables hold rows and cells where the documents come from packages."""
        cells = self._body().filter("kind = 'cell'").select("doc_id", "seq", "row_idx", "col_idx", "text") if "row_idx" in self.rows.columns else None
        rows = self._body().filter("kind <> 'cell'").select("doc_id", "seq", "kind", "text")
        if cells is not None:
            rows = rows.unionByName(cells.select("doc_id", "seq").distinct().select("doc_id", "seq", F.lit("table").alias("kind"), F.lit("").alias("text")))
        return text_sink.nested_json(rows, cells)

    def to_editable_html(self) -> DataFrame:
        return text_sink.editable_html(self.of_kind("paragraph"))

    def assembled(self, **options) -> DataFrame:
        """Pieces of paragraphs, images and rows of tables on A4 pages."""
        if "row_idx" not in self.rows.columns:
            return assembly.assembled(assembly.measured(self.rows), **options)
        body = self._body().filter("kind IN ('paragraph', 'cell', 'image')").withColumn("kind", F.when(F.col("kind") == "cell", "table").otherwise(F.col("kind")))
        blocks = body.groupBy("doc_id", "seq", "kind").agg(F.max("text").alias("text"), (F.coalesce(F.max("row_idx"), F.lit(0)) + 1).alias("_rows"))
        measured = assembly.measured(blocks, "_rows")
        return assembly.assembled(measured, **options)

    def to_pdf(self, size: float = 11.0, per_page: int = 50, width: float = 451.3) -> DataFrame:
        """(doc_id, content): one file a document, its texts wrapped by the plain width rule."""
        columns = max(1, int(width / (0.6 * size)))
        at = ["seq", *(c for c in ("row_idx", "col_idx") if c in self.rows.columns)]
        lines = self._body().filter("text IS NOT NULL").select("doc_id", *at, F.posexplode(F.split(F.expr(T.wrap("text", columns)), "\n")).alias("_line", "text"))
        whole = lines.select("doc_id", F.struct(*at, "_line").alias("seq"), "text")
        return pdf_sink.write_pdfs(pdf_sink.set_lines(whole, per_page=per_page, size=size), "doc_id")

    def to_workbooks(self) -> DataFrame:
        """(doc_id, content): one workbook a document: tables with captions, and paragraphs, in order."""
        own = self._body().filter("kind NOT IN ('cell', 'image')").select("doc_id", "seq", F.lit("paragraph").alias("kind"), "text", F.lit(0).alias("row_idx"), F.array().cast("array<string>").alias("cells"), F.lit(False).alias("is_header"))
        if "row_idx" in self.rows.columns:
            cells = F.sort_array(F.collect_list(F.struct("col_idx", "text")))["text"].alias("cells")
            tables = self._body().filter("kind = 'cell'").groupBy("doc_id", "seq", "row_idx").agg(cells, F.max("is_header").alias("is_header"))
            own = own.unionByName(tables.withColumns({"kind": F.lit("table"), "text": F.lit("")}))
        return workbook_sink.write_workbooks(workbook_sink.row_plan(own))

    def to_packages(self) -> DataFrame:
        """(doc_id, content): one package a document, of its paragraphs in order."""
        own = F.sort_array(F.collect_list(F.struct("seq", "text")))["text"]
        return package_sink.write_packages(self.of_kind("paragraph").groupBy("doc_id").agg(own.alias("lines")), "doc_id", "lines")

