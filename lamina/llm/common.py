"""What the operators of this subpackage share: scratch tables, exact row carriers, joins on hot keys, word rules, file systems."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs without ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of one key from which on it may be hot, and the most keys that can be: a hot key has over 1 / HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 4096, 50_000


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lamina-scratch")
    return f"{base.rstrip('/')}/lamina-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or scratch(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_batches(docs: DataFrame, rows: int = 512) -> DataFrame:
    """``docs``, with the session's Arrow batches cut to ``rows`` rows if they are larger: Python workers hold whole texts."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def id_text(column: str = "doc_id") -> Column:
    """The id as text. pandas turns a batch of longs with a null into doubles, which lose ids over 2 ** 53; text passes exactly, null as None."""
    return F.col(column).cast("long").cast("string").alias(column)


def id_long(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` with an id that came back as text as a long again."""
    return df.withColumn(column, F.col(column).cast("long"))


def beside(docs: DataFrame, keep: list[str], inputs: list[str], compute: Callable[..., list], added: str) -> DataFrame:
    """``keep`` columns of every row as they came, then the columns ``added`` (a schema) that ``compute`` makes of a batch's ``inputs``, a list for each.

    The kept columns stay Arrow arrays in the Python worker, so no type or null of theirs is touched, and their names may clash with any other.
    """
    new, n = StructType.fromDDL(added), len(keep)
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)))
    schema = StructType([*kept.schema.fields[:n], *(type(f)(f"_n{i}", f.dataType) for i, f in enumerate(new.fields))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            columns = compute(*(c.to_pylist() for c in batch.columns[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], names=schema.names)

    found = text_batches(kept).mapInArrow(run, schema)
    return found.toDF(*keep, *new.names)


def joined(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` (``total`` of them, a written table) with the one row of ``keyed`` for each key ``on``; its column ``n`` counts the key's rows.

    Hot keys, at most HOT_KEYS since each has over 1 / HOT_KEYS of all rows, go to all tasks, so their rows stay where they are.
    The rows of other keys meet in a shuffle.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    if total <= bound:
        return rows.join(keyed, on)
    hot = F.broadcast(keyed.filter(F.col("n") > bound))
    cold = keyed.filter(F.col("n") <= bound)
    return rows.join(hot.select(*on), on, "left_anti").join(cold, on).unionByName(rows.join(hot, on))


def file_system(path: str):
    """pyarrow's file system of a Hadoop-style path and the path below it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = "/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):  # Hadoop's names of the connector that pyarrow calls s3
        path = f"s3:{rest}"
    elif scheme in ("wasb", "wasbs"):
        path = f"abfss:{rest}"
    return fs.FileSystem.from_uri(path)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case. bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
