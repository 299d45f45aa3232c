"""Which media of a document are one: a chain of keys, a number for each, and one number for all references to the same file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_package(path: Column) -> Column:
    """A path within the package: what was unpacked to a temporary folder counts from `word/` on."""
    return F.when(path.contains("/tmp/") & path.contains("word/"), F.expr("substring(_path, instr(_path, 'word/'))")).otherwise(path)


def media_key() -> Column:
    """`path::`, else `rel::` with its context, else `md5::` of the description with its entries in order."""
    path = F.col("path").isNotNull() & (F.col("path") != "N/A")
    by_rel = F.concat_ws("::", F.lit("rel"), "rel_id", F.nullif("context", F.lit("")))
    entries = F.array_sort(F.map_entries(F.coalesce(F.from_json("info", "map<string,string>"), F.create_map().cast("map<string,string>"))))
    return F.when(path, F.concat(F.lit("path::"), from_package(F.col("_path")))).when(F.col("rel_id").isNotNull(), by_rel).otherwise(F.concat(F.lit("md5::"), F.md5(F.to_json(entries))))


def registered(media: DataFrame, targets: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(references, dictionary) of a document's media (key, seq, path, rel_id, context, info): (key, seq, id) for each and (key, id, path, info) for each that is kept.

    Media of one key are one. Then what a relationship leads to is known (``targets``: key, rel_id, path), and keys of one file are one as well: the first stays, and ids are numbered
    anew by first use from 0, so references and dictionary agree. ``path`` is the file within the package, null where nothing says it.
    """
    own = media.withColumn("_path", F.col("path")).withColumn("_key", media_key()).drop("_path")
    first = own.groupBy(key, "_key").agg(F.min_by(F.struct("path", "rel_id", "info"), "seq").alias("_m"), F.min("seq").alias("_first"))
    known = targets.select(key, F.col("rel_id").alias("_rel"), F.col("path").alias("_target")).dropDuplicates([key, "_rel"])
    found = first.withColumn("_rel", F.when(F.col("_key").startswith("rel::"), F.col("_m.rel_id"))).join(known, [key, "_rel"], "left")
    path = F.when(F.col("_key").startswith("path::"), F.expr("substring(_key, 7)")).otherwise(F.col("_target"))
    whole = F.when(path.startswith("word/") | ~path.contains("media"), path).otherwise(F.concat(F.lit("word/"), path))
    same = found.withColumn("_file", whole).withColumn("_one", F.coalesce("_file", "_key"))
    kept = same.groupBy(key, "_one").agg(F.min("_first").alias("_at"), F.min_by("_m", "_first").alias("_m"), F.first("_file").alias("_file"))
    numbered = kept.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1)
    ids = same.select(key, "_key", "_one").join(numbered.select(key, "_one", "id"), [key, "_one"]).select(key, "_key", "id")
    references = own.select(key, "seq", "_key").join(ids, [key, "_key"]).select(key, "seq", "id")
    return references, numbered.select(key, "id", F.col("_file").alias("path"), F.col("_m.info").alias("info"))
