"""Documents as streams: files that arrive in a folder become elements; whatever works row by row works there too.

Operators that need a whole document (statistics, order, writers) run in each micro-batch, because a file brings its document whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lamina.document import Documents
from lamina.sources import html, package

FILES = "path string, modificationTime timestamp, length long, content binary"


def packages(spark: SparkSession, folder: str, pattern: str = "*.docx", files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of the packages that arrive."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def elements(spark: SparkSession, folder: str, what: str = "elements") -> DataFrame:
    """Rows of one kind of the packages that arrive; the scan keeps no state."""
    return package.scan(packages(spark, folder), what).withColumnRenamed("path", "doc_id")


def pages(arriving: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """Elements of the HTML pages of a stream."""
    return html.scan_pages(arriving, key, source).withColumnRenamed(key, "doc_id")


def each_batch(arriving: DataFrame, change: Callable[[Documents], DataFrame], target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that applies ``change`` to the documents of each batch and writes its rows as Parquet.

    Each batch has a folder of its own that a repeated batch overwrites, so a restart doubles nothing. ``once`` takes what is there and ends.
    """

    def run(batch: DataFrame, number: int) -> None:
        change(Documents(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
