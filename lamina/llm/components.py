"""Connected components of an edge table by alternating large-star and small-star passes.

Each pass is a partial minimum by node and a join. No node's neighbours are gathered in one task: those of a star's centre with very many edges
take its minimum from a broadcast of such centres (``common.joined``). The passes number about the square of the logarithm of
the largest component at most, a handful in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

#: More passes than any graph of 2 ** 64 nodes should need.
PASSES = 200


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v) long edges -> (node, root): each node of an edge with the least node that it can reach. Raises if it isn't done after PASSES passes."""
    now = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges-0", folder)
    seen, total = None, now.count()
    for step in range(1, PASSES):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = common.joined(both, _lowest(both), ["u"], 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = common.written(large.filter("u <> v").distinct(), f"large-{step}", folder)
        lowest = _lowest(small)
        star = common.joined(small, lowest, ["u"], 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v")
        now = common.written(star.distinct(), f"edges-{step}", folder)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, total = state, state.n
    raise RuntimeError(f"components not found in {PASSES} passes")
