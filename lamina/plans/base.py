"""Registration of queries: a builder or a Spark SQL text, with its oracle in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

#: Lines of documents as rows, in both dialects.
PARA = "(SELECT doc_id, posexplode(split(text, '\\n')) AS (seq, text) FROM documents)"
#: What small documents are made of: every part is a block, and five of them are a document (``n_regionkey``).
NATION = "(SELECT CAST(p_partkey AS INT) AS n_nationkey, concat(p_name, ' ', p_partkey) AS n_name, CAST(floor(p_partkey / 5) AS INT) AS n_regionkey FROM part)"
PARA_DUCK = "(SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NATION as a DataFrame."""
    return table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS INT) AS n_nationkey", "concat(p_name, ' ', p_partkey) AS n_name", "CAST(floor(p_partkey / 5) AS INT) AS n_regionkey")


def query(name: str, oracle: str | None = None):
    """Decorator for builders (spark, sf_dir) -> DataFrame."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle.replace("$PARA", PARA_DUCK).replace("$NATION", NATION)
        return f

    return add


def sql(name: str, spark_sql: str, oracle: str | None = None, deal: bool = False) -> None:
    """A query in Spark SQL; ``$PARA`` stands for the lines of documents. Without an oracle of its own the text serves both. ``deal``: a row is much work, so tables go over all cores first."""
    body, used = spark_sql.replace("$PARA", PARA).replace("$NATION", NATION), [t for t in TABLES if re.search(rf"\b{t}\b", spark_sql.replace("$PARA", "documents").replace("$NATION", "part"))]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            rows = table(spark, sf_dir, t)
            (scratch.dealt(rows) if deal else rows).createOrReplaceTempView(t)
        return spark.sql(body)

    QUERIES[name] = run
    ORACLES[name] = (oracle or spark_sql).replace("$PARA", PARA_DUCK).replace("$NATION", NATION)

