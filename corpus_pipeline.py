"""From raw documents to packed sequences: language ID, quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents. They need no other
table, so sf_dir plays no part in them. ``run`` writes each stage's result as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common, langid, line_templates, packing, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose two best languages lie too close; learned from all rows with a language."""
    docs = docs.select(*COLUMNS)
    return langid.identify(docs, langid.fit(docs), *COLUMNS).filter("accepted").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the current policy fails. The measurements sit beside the row; nothing is joined."""
    return quality.keep(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates after their first document, and documents that have no word left; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    found = line_templates.drop_lines(docs.withColumnRenamed("n_chars", "old_chars"), "doc_id", "lang", "source", "old_chars")
    changed = F.size("dropped") > 0
    found = found.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.select("doc_id", "text", "lang", "source", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("old_chars").cast("long")).alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of least doc_id."""
    return simhash.representatives(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4,096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language", language_stage), ("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("packing", packing_stage)]

#: Compression sizes, SimHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.scratch(spark)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name, folder)
    return docs
