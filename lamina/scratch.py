"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lamina-scratch")
    return f"{base.rstrip('/')}/lamina-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: it cuts lineage, is computed once and survives lost executors."""
    path = f"{at or folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores: a table in one small file is one task otherwise, however much work its rows make, and Spark counts their bytes alone."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def by_row(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str, rows: int = 32) -> DataFrame:
    """What ``make`` gives for each row's values, as rows of ``schema``. ``rows`` of them are Python objects at a time, and their results leave before the next are read, so memory doesn't grow with Arrow's batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                found = [r for values in zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True) for r in make(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
