"""Operator 7: SimHash near-duplicates by pivot distance tables.

Distinct fingerprints go into a table with their Hamming distances to many reference fingerprints, the pivots. Two fingerprints at
distance d have coordinates that differ by d at most, so a pair whose largest coordinate difference is over the limit is
discarded unseen; survivors are verified. Which pairs meet at all: with ``limit`` differing bits over ``blocks`` blocks at
least ``blocks - limit`` blocks agree in full, and each choice of so many blocks is one table of buckets. In a bucket, members are sorted
by their first coordinate and only neighbours within the limit are paired. A bucket gives the edges of a spanning star of each of its
components, never all pairs. The members of crowded buckets are dealt out again over FINE blocks, whose buckets hold at most 4,096 distinct fingerprints (those that
differ in three half-bytes), so no bucket and no pair table grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm.components import components

LIMIT, SHINGLE, SEED, PIVOTS = 3, 3, 42, 16
#: Members of a bucket from which on they are dealt out again, over FINE blocks.
CROWDED, FINE = 2048, 16
#: Buckets up to this size are paired by shifts over a whole batch.
SMALL = 24
#: Numbers of blocks, tried in turn until the buckets of random fingerprints would hold few members.
BLOCKS, FEW = (4, 5, 6, 7, 8), 8

#: For each byte, its bits as eight byte-wide lanes of one integer.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Bits set in over half the shingles' XXH64, as a signed 64-bit integer; 0 without words."""
    from xxhash import xxh64_digest

    words = common.words_of(text)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = xxh64_digest(joined, SEED)
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
        hashes = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)])
    lanes = LANES[np.frombuffer(hashes, np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a lane holds up to 255
    counts = sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)  # most significant byte first, in it the lowest bit first
    bits = np.packbits(counts * 2 > len(lanes), axis=1, bitorder="little")
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and fp of every row's ``text`` column."""
    return common.beside(docs, list(keep), [text], lambda texts: [[fingerprint(t) for t in texts]], "fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: zero, then hashes of 1, 2, ..."""
    from xxhash import xxh64_intdigest

    return np.array([0, *(xxh64_intdigest(str(i).encode(), SEED) for i in range(1, count))], dtype=np.uint64)


def coordinates(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ references[None, :]).astype(np.int8)


def close(fps: np.ndarray, coords: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs left after the coordinates, one pivot after the other, and the verification."""
    for k in range(coords.shape[1]):
        near = np.abs(coords[i, k] - coords[j, k]) <= limit
        i, j = i[near], j[near]
        if not len(i):
            return i, j
    near = np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= limit
    return i[near], j[near]


def star_edges(fps: np.ndarray, coords: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from each member of a bucket to the least fingerprint of its component there. Memory is a few blocks of pairs."""
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order]
    n, reach = len(fps), np.searchsorted(coords[:, 0], coords[:, 0] + limit, side="right")
    root = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    step = max(1, 1_000_000 // n)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        spans = reach[rows] - rows - 1
        i = np.repeat(rows, spans)
        j = np.arange(len(i)) - np.repeat(np.cumsum(spans) - spans, spans) + i + 1
        i, j = close(fps, coords, i, j, limit)
        while len(i):  # hook the larger root on the smaller until nothing joins any more
            a, b = find(i), find(j)
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    top = find(np.arange(n))
    inside = np.flatnonzero(top != np.arange(n))
    if len(inside):
        yield fps[inside], fps[top[inside]]


def block_masks(blocks: int, limit: int) -> list[int]:
    """One mask for each choice of the blocks that agree; the blocks of 64 bits are as even as can be."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - limit)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """(u, v) long: edges between distinct fingerprints (column fp) whose components are those of all links of ``limit`` bits or fewer."""
    references = pivots()

    def with_pivots(batches):
        for pdf in batches:
            yield pdf.assign(coords=[c.tobytes() for c in coordinates(pdf.fp.to_numpy(), references)])

    table = common.written(distinct.select("fp").mapInPandas(with_pivots, "fp long, coords binary"), "pivots", folder)
    n = table.count()
    blocks = next((b for b in BLOCKS if n >> (64 * (b - limit) // b) <= FEW), BLOCKS[-1])
    masks = block_masks(blocks, limit)
    def dealt(members: DataFrame, masks: list[int], crowd: int | None) -> tuple[DataFrame, DataFrame | None]:
        """(fp, coords, cell) of the buckets with two members or more, and the members of those with more than ``crowd``."""
        keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)))).alias("x")
        rows = members.select("fp", "coords", keys).select("fp", "coords", "x.t", "x.k")
        held = common.written(rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"), f"held-{len(masks)}", folder)
        total = n * len(masks)
        cells = common.joined(rows, held if crowd is None else held.filter(F.col("n") <= crowd), ["t", "k"], total).select("fp", "coords", F.xxhash64(F.lit(len(masks)), "t", "k").alias("cell"))
        if crowd is None or not held.filter(F.col("n") > crowd).limit(1).count():
            return cells, None
        return cells, common.joined(rows, held.filter(F.col("n") > crowd), ["t", "k"], total).select("fp", "coords").distinct()

    ready, crowded = dealt(table, masks, CROWDED)
    if crowded is not None:
        ready = ready.unionByName(dealt(common.written(crowded, "crowded", folder), block_masks(FINE, limit), None)[0])

    def pair_up(batches):
        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            cell = pdf.cell.to_numpy()
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            kept = pdf.iloc[done:]
            yield from edges(pdf.iloc[:done])
        if kept is not None:
            yield from edges(kept)

    def edges(pdf: pd.DataFrame):
        if not len(pdf):
            return
        fps, cell = pdf.fp.to_numpy(), pdf.cell.to_numpy()
        coords = np.frombuffer(b"".join(pdf.coords), np.int8).reshape(len(pdf), -1)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        us, vs = [], []
        small = np.repeat(sizes, sizes) <= SMALL
        for shift in range(1, SMALL):
            i = np.flatnonzero(small[:-shift] & (cell[shift:] == cell[:-shift])) if shift < len(cell) else np.zeros(0, int)
            if not len(i):
                break
            i, j = close(fps, coords, i, i + shift, limit)
            us.append(fps[i])
            vs.append(fps[j])
        for at, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            for u, v in star_edges(fps[at : at + size], coords[at : at + size], limit):
                us.append(u)
                vs.append(v)
        if us:
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    count = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return ready.repartition(int(count), "cell").sortWithinPartitions("cell").mapInPandas(pair_up, "u long, v long")


def grouped(prints: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """(fp, component_id, n: copies) of each distinct fingerprint among rows (doc_id, fp)."""
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct", folder)
    found = components(links(distinct, folder, limit), folder)
    rooted = common.written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root")), "rooted", folder)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    return common.joined(rooted, least, ["root"], rooted.count()).select("fp", "component_id", F.col("copies").alias("n"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of all rows reachable over links), copies (rows with this fingerprint).

    Null and blank texts have fingerprint zero and link like any other. Rows of equal doc_id stay rows; a null doc_id is never
    the least unless its component has no other. Equal fingerprints are one node, whatever their number. An empty table gives no rows; other columns play no part.
    A very long text is read whole, in memory of some ten times its words.
    """
    folder = common.scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.written(fingerprints(rows, "doc_id"), "fingerprints", folder)
    named = common.written(grouped(rows, folder, limit), "named", folder)
    return common.joined(rows, named, ["fp"], rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("copies"))


def representatives(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id (null last), of rows with that doc_id the text of the least hash, then the first row.

    The chosen row numbers come from fingerprints alone; texts stay in the written table until the last join.
    """
    folder = common.scratch(docs.sparkSession)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_order"))
    rows = fingerprints(rows, *names.values(), "doc_id", "_order", text=names["text"])
    rows = common.written(rows.withColumn("_rid", F.monotonically_increasing_id()), "rows", folder)
    named = common.written(grouped(rows.select("doc_id", "fp"), folder, limit), "named", folder)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_order", "_rid")
    chosen = common.joined(rows.select("fp", "doc_id", "_order", "_rid"), named, ["fp"], rows.count()).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(place)["_rid"].alias("_rid"))
    return rows.join(chosen.select("_rid"), "_rid").select(*(F.col(n).alias(c) for c, n in names.items()))
