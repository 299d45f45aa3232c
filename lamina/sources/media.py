"""Media of packages and folders as rows with their class, and XML parts as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import formats


def with_class(media: DataFrame, content: str = "content") -> DataFrame:
    """Adds type (image, font, pdf, archive, other), format, size and md5 by the first bytes; the name plays no part."""
    return media.withColumns({"type": F.expr(formats.media_class(content)), "format": F.expr(formats.sniff(content)), "size": F.octet_length(content), "md5": F.md5(content)})


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, type, format, size, md5) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return with_class(files.select("path", "content"))


def added(media: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """Media of both sides; of equal contents of a document one stays, with the least path."""
    own = with_class(media.unionByName(more))
    return own.groupBy(key, "md5").agg(*(F.min_by(c, "path").alias(c) for c in ("path", "content", "type", "format", "size")))


def mapped(rows: DataFrame, xml: str, **fields: str) -> DataFrame:
    """Columns from an XML text by element: name -> "tag" or "tag@attribute" (local names), each the first that there is; the type after a colon casts it."""
    out = {}
    for name, rule in fields.items():
        where, _, kind = rule.partition(":")
        tag, _, attribute = where.partition("@")
        path = f"//*[local-name()=\"{tag}\"]" + (f"/@*[local-name()=\"{attribute}\"]" if attribute else "/text()")
        first = F.get(F.expr(f"xpath({xml}, '{path}')"), F.lit(0))
        out[name] = first.try_cast(kind) if kind else first
    return rows.withColumns(out)
