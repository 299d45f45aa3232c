"""Operator 9: sharding over fixed virtual slots.

Records hash into a few thousand virtual slots for good. Bytes and rows are summed up per slot, and a versioned map says which shard
holds each slot. The map is stored; rebalancing loads it, moves single slots and stores the result as its next version, and never touches the
records: version 1 deals the slots in turn, version 2 has moved just the slots that even out the bytes. ``grow`` moves slots into new shards only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import common

SLOTS = 4096
#: Rows of a slot that are numbered in one run.
ROWS = 50_000


@dataclass
class SlotMap:
    """Slot -> shard, one array a version. At most a few thousand slots, so it lives on the driver."""

    shards: int
    versions: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [np.arange(slots) % shards])

    @property
    def current(self) -> np.ndarray:
        return self.versions[-1]

    def loads(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.current, weights, self.shards)

    def rebalance(self, weights: np.ndarray) -> SlotMap:
        """A next version: while it helps, the fullest shard gives the emptiest the slot nearest to half their difference, or swaps two."""
        now, loads = self.current.copy(), self.loads(weights)
        for _ in range(64 * len(now)):
            full, empty = int(np.argmax(loads)), int(np.argmin(loads))
            gap = loads[full] - loads[empty]
            mine, other = np.flatnonzero((now == full) & (weights > 0)), np.flatnonzero((now == empty) & (weights > 0))
            if gap <= 1 or not len(mine):
                break
            move = mine[np.argmin(np.abs(weights[mine] - gap / 2))]
            gain, back = weights[move], None
            if len(other):  # a swap comes nearer to the half than a move where slots are coarse
                order = other[np.argsort(weights[other], kind="stable")]
                at = np.clip(np.searchsorted(weights[order], weights[mine] - gap / 2), 0, len(order) - 1)
                pick = int(np.argmin(np.abs(weights[mine] - weights[order[at]] - gap / 2)))
                swap = weights[mine[pick]] - weights[order[at[pick]]]
                if abs(swap - gap / 2) < abs(gain - gap / 2):
                    move, back, gain = mine[pick], order[at[pick]], swap
            if not 0 < gain < gap:
                break
            now[move] = empty
            if back is not None:
                now[back] = full
            loads[full] -= gain
            loads[empty] += gain
        return SlotMap(self.shards, [*self.versions, now])

    def grow(self, weights: np.ndarray, shards: int) -> SlotMap:
        """A next version with more shards: slots move into the new ones alone, until those hold their share."""
        now, loads = self.current.copy(), np.append(self.loads(weights), np.zeros(shards - self.shards))
        share = weights.sum() / shards
        for new in range(self.shards, shards):
            while loads[new] < share:
                full = int(np.argmax(loads[: self.shards]))
                mine = np.flatnonzero((now == full) & (weights > 0))
                fits = mine[weights[mine] <= share - loads[new]]
                if not len(fits):
                    break
                move = fits[np.argmax(weights[fits])]
                now[move] = new
                loads[full] -= weights[move]
                loads[new] += weights[move]
        return SlotMap(shards, [*self.versions, now])

    def save(self, spark: SparkSession, path: str, since: int = 0) -> SlotMap:
        """Writes the versions after the first ``since``, a Parquet folder each; stored versions are never written again."""
        for version in range(since + 1, len(self.versions) + 1):
            rows = [(s, int(k), self.shards) for s, k in enumerate(self.versions[version - 1])]
            spark.createDataFrame(rows, "vslot int, shard int, shards int").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """All versions of a stored map (slots x versions rows)."""
        found: dict[int, dict[int, int]] = {}
        rows = spark.read.parquet(path).orderBy("version", "vslot").collect()
        for r in rows:
            found.setdefault(r.version, {})[r.vslot] = r.shard
        return cls(rows[-1].shards, [np.array([m[s] for s in sorted(m)]) for _, m in sorted(found.items())])


def record_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row. The slot is a hash of the three, so rows of one doc_id, or without any, spread over the slots by their texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def start(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
    """Stores version 1 of a new map, the slots dealt in turn."""
    return SlotMap.initial(shards, slots).save(spark, path)


def shard(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot (the row's place in its shard), grown_shard (null), vslot, map_version.

    The map stored at ``path`` is loaded and edited for the bytes that its slots now hold: if it has fewer shards, slots move into the new ones; then
    slots move to even out the shards. Each edit is stored as a further version, and the rows are placed by the last one. Without an edit no version is added.
    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32 of a null text: 0. Equal rows share a slot. An empty table gives no rows; columns other than doc_id
    and text play no part. A slot with more bytes than a shard's share, such as one very long text, is a shard's fullest.
    Only slot totals reach the driver; a row crosses the network once, without its text. Places are counted in runs of some ROWS rows.
    """
    spark = docs.sparkSession
    slot_map = SlotMap.load(spark, path)
    slots, before = len(slot_map.current), len(slot_map.versions)
    if slot_map.shards > shards:
        raise ValueError(f"the map at {path} has {slot_map.shards} shards")
    rows = common.written(record_slots(docs, slots), "rows")
    weights, n = np.zeros(slots), 0
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        weights[r.vslot] = r.bytes
        n += r.n
    if slot_map.shards < shards:
        slot_map = slot_map.grow(weights, shards)
    edited = slot_map.rebalance(weights)
    slot_map = edited if (edited.current != slot_map.current).any() else slot_map
    version = len(slot_map.save(spark, path, before).versions)
    stored = F.broadcast(spark.read.parquet(f"{path}/version={version}").select("vslot", "shard"))  # one row a slot
    # the rows of a slot are cut into runs by a hash, the runs of a shard follow each other, and rows are numbered within their run
    run = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("run")), F.lit(max(1, n // (slots * ROWS)))).cast("int")
    rows = rows.withColumn("run", run)
    sizes = rows.groupBy("vslot", "run").agg(F.count("*").alias("n")).join(stored, "vslot")
    ahead = sizes.select("vslot", "run", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "run")) - F.col("n")).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("vslot", "run").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32"))
    return rows.withColumn("inner", inner).join(ahead, ["vslot", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("inner") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
    )
