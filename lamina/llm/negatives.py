"""Operator 12: hard negatives by a two-dimensional block matrix multiply in the manner of SUMMA.

The score matrix of anchors and rows is cut into tiles: a block of anchors against a block of rows. A tile stays where it is: its panels of anchors and of rows are
shuffled to the task that owns it, which adds up the products of one chunk of dimensions after the other, a strip of anchors at a time. Tiles are reduced where they are
made and never leave their task, so they are made twice: first each gives its best same-label rows, which make the anchors' positives; then their windows of scores choose
each tile's best rows of other labels. A last shuffle of those few rows takes the best of all tiles.

Blocks hold rows by a hash of the row, so no label or vector makes one of them larger, and fewer rows where vectors are long. Tiles number anchors times rows, as every
anchor meets every row; what is shuffled are rows, once for each block of anchors, and anchors, once for each block of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import common

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
SCALE = 256
#: Rows of a block of anchors and of a block of rows at most, of a block of rows at least where cores would idle; values of a panel at most; anchors of a strip and dimensions of a chunk.
ANCHORS, ROWS, SPLIT, VALUES, STRIP, CHUNK = 2048, 8192, 1024, 1 << 20, 256, 256
NEAR = "anchor long, score long, id long, key long"
FOUND = "anchor long, positive long, anchor_id long, positive_id long, positive_score long, negative long, negative_id long, negative_score long"


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(key, vec_id, label, x) of the rows that take part, written, and the length of their vectors (0: none). ``x`` is an array of the narrowest whole numbers that hold all components."""
    good = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as int) label", "cast(embedding as array<double>) embedding").filter(good)
    label = f"if(vec_id % {RELABEL_EVERY} = 0, cast((cast(label as long) + 1) % {LABELS} as int), label)"
    rows = rows.selectExpr("monotonically_increasing_id() key", "vec_id", f"{label} label", f"transform(embedding, c -> floor({SCALE} * c)) x")
    rows = common.written(rows, "prepared")  # the key of a row stays
    widths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return rows, 0
    most = max(widths[0].high, -widths[0].low)
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    return rows.filter(F.size("x") == widths[0].d).withColumn("x", F.col("x").cast(f"array<{kind}>")), widths[0].d


def strips(left, right) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores) of a tile, a strip of anchors at a time. Floats multiply where every sum fits their bits, longs elsewhere (which wrap around beyond 64 bits)."""
    x, y = (t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
    d = x.shape[1]
    most = max(int(x.max()), -int(x.min())) * max(int(y.max()), -int(y.min())) * min(d, CHUNK)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    for at in range(0, len(x), STRIP):
        tile = np.zeros((len(x[at : at + STRIP]), len(y)), np.int64)
        for k in range(0, d, CHUNK):
            tile += (x[at : at + STRIP, k : k + CHUNK].astype(kind) @ y[:, k : k + CHUNK].astype(kind).T).astype(np.int64)
        yield at, tile


def names(table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in columns]


def as_table(found: list[list[np.ndarray]], columns: str):
    """Arrays of several places, put together as columns of longs."""
    import pyarrow as pa

    each = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(columns.count(",") + 1)]
    return pa.table([pa.array(c, pa.int64()) for c in each], names=[c.split()[0] for c in columns.split(",")])


def best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    """The places of the ``count`` highest scores; ties by id, then key."""
    if len(scores) > 4 * count:  # all that tie with the last one stay
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((keys[near], ids[near], -scores[near]))[:count]]


def near_rows(left, right):
    """A tile's best same-label rows of each of its anchors."""
    if not left.num_rows or not right.num_rows:
        return as_table([], NEAR)
    right = right.sort_by("label")
    anchors, anchor_labels = names(left, "key", "label")
    keys, ids, labels = names(right, "key", "vec_id", "label")
    low, high = (np.searchsorted(labels, anchor_labels, side) for side in ("left", "right"))
    found = []
    for at, tile in strips(left, right):
        for i, scores in enumerate(tile, at):
            own = slice(low[i], high[i])
            places = low[i] + best(scores[own], ids[own], keys[own], POSITIVES + 1)  # the anchor itself may be one
            places = places[keys[places] != anchors[i]][:POSITIVES]
            found.append([np.full(len(places), anchors[i]), scores[places], ids[places], keys[places]])
    return as_table(found, NEAR)


def found_negatives(left, right):
    """A tile's best rows of other labels within the window of scores of each of its anchors' positives."""
    if not left.num_rows or not right.num_rows:
        return as_table([], FOUND)
    anchors, anchor_ids, anchor_labels = names(left, "key", "vec_id", "label")
    keys, ids, labels = names(right, "key", "vec_id", "label")
    wanted = left.column("wanted").to_pylist()
    found = []
    for at, tile in strips(left, right):
        for i, scores in enumerate(tile, at):
            top = max(p["score"] for p in wanted[i])
            least = min(-(-4 * p["score"] // 5) for p in wanted[i])  # 80 * positive <= 100 * negative, in whole numbers
            near = np.flatnonzero((scores <= top) & (scores >= least) & (labels != anchor_labels[i]))
            for p in wanted[i] if len(near) else ():
                within = near[(scores[near] <= p["score"]) & (scores[near] >= -(-4 * p["score"] // 5))]
                within = within[best(scores[within], ids[within], keys[within], NEGATIVES)]
                same = [np.full(len(within), v) for v in (anchors[i], p["key"], anchor_ids[i], p["id"], p["score"])]
                found.append([*same, keys[within], ids[within], scores[within]])
    return as_table(found, FOUND)


def tiles(anchors: DataFrame, rows: DataFrame, reduced: Callable, schema: str, blocks: tuple[int, int]) -> DataFrame:
    """What ``reduced`` gives for each tile's anchors and rows. Panels are plain rows on their way, so no large value is written, shuffled or put in a batch."""
    down, across = blocks
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tall = anchors.withColumn("a", block(down)).withColumn("b", everywhere(across))
    wide = rows.withColumn("b", block(across)).withColumn("a", everywhere(down)).toDF(*rows.columns, "b", "a")  # both sides come of one table
    sides = [df.repartition(tasks, "a", "b").groupBy("a", "b") for df in (tall, wide)]  # a tile's work doesn't show in its bytes, by which tasks would be put together
    return sides[0].cogroup(sides[1]).applyInArrow(reduced, schema)


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each ``by``; Spark cuts each task's rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor and positive.

    Rows with a null vec_id, label or vector, an empty vector, a null or non-finite component, or a vector of another length than the most frequent
    (ties: the longest) take no part. Every row counts for itself: a repeated row is one more candidate (and positive) of its copies, and a repeated anchor is one more anchor with
    rows of its own; what ties in score and vec_id is kept in an order of its own. Scores are exact while they fit a long. A positive without a row in its window, as all with a score below
    0, has no rows, so an empty table gives none. Other columns play no part.
    """
    rows, d = prepared(vectors)
    if not d:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    count, panel = rows.count(), max(1, VALUES // d)
    parts = lambda n, size: max(1, -(-n // size))
    down = parts(anchors.count(), min(ANCHORS, panel))
    across = max(parts(count, min(ROWS, panel)), min(rows.sparkSession.sparkContext.defaultParallelism, parts(count, SPLIT)))
    folder = common.scratch(rows.sparkSession)
    near = common.written(tiles(anchors, rows, near_rows, NEAR, (down, across)), "tiles", folder)
    positives = ranked(near, ["anchor"], [F.desc("score"), F.asc("id"), F.asc("key")], POSITIVES)
    wanted = common.written(positives.groupBy("anchor").agg(F.collect_list(F.struct("key", "id", "score")).alias("wanted")), "positives", folder)
    owners = anchors.join(wanted.withColumnRenamed("anchor", "key").hint("merge"), "key")
    found = tiles(owners, rows, found_negatives, FOUND, (down, across))
    first = ranked(common.written(found, "negatives", folder), ["anchor", "positive"], [F.desc("negative_score"), F.asc("negative_id"), F.asc("negative")], NEGATIVES)
    return first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB's SQL, all anchors against all rows.
ORACLE = f"""
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, a.label = r.label AS same, r.k AS rk, r.vec_id AS id,
         list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e AS a JOIN e AS r ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.k <> r.k),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, id, rk) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.ak, p.rk ORDER BY s.score DESC, s.id, s.rk)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= {NEGATIVES}
"""
