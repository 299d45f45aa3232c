"""The thin queries of the operators and the pipeline, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lamina.llm import ann, bpe_dp, common, langid, line_templates, negatives, packing, ppm, quality, secrets, sharding, simhash, token_store, whitening


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_documents(spark, sf_dir), common.held_remainder("doc_id", 7) != 2)


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_store(_documents(spark, sf_dir), f"{common.scratch(spark)}/tokens", _tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dp.encode_and_decode(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.deduplicated(_documents(spark, sf_dir))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(_documents(spark, sf_dir))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new map of eight shards is stored, then loaded, edited for the table's bytes and stored as its next version."""
    path = f"{common.scratch(spark)}/slot-map"
    sharding.start(spark, path, shards=8)
    return sharding.shard(_documents(spark, sf_dir), path, shards=8)


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_documents(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.policy_report(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_posting_lists, op2_ppm, op3_quality_ledger, op4_token_frames, op5_bpe_prefixes, op6_line_templates, op7_simhash_pivots, op8_language_id, op9_virtual_slots, op10_cutting_stock, op11_whitening, op12_hard_negatives, op13_secret_battery, quality_ablations, pipeline)}
ORACLES = {"op3_quality_ledger": quality.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_secret_battery": secrets.ORACLE, "quality_ablations": quality.REPORT_ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

