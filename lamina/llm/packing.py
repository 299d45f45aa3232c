"""Operator 10: packing token sequences by cutting-stock column generation.

Every document's ids are cut into whole sequences and one remainder. The remainders of most documents, by length class, are the
demand of a cutting-stock problem: a linear program over patterns (how many remainders of each class share a sequence), whose columns
a knapsack dynamic program prices. Rounded patterns are dealt to the documents in order of their rank in their class. What the
patterns leave free is laid out as one line, and the ids of the other documents (fillers, taken by a hash of doc_id until they
suffice) run along that line and are cut where a sequence ends. The rest of the line goes on in whole sequences; its last
ids go to sequences whose lengths are powers of two. Hence no sequence has padding, and only fillers are cut into more than needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm.encoders import shared_encoder

LENGTH = 4096
#: Length classes of remainders; a pattern holds at most so many class units.
UNITS = 128
#: Buckets of the hash that picks fillers.
FILLER_BUCKETS = 1000


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of largest total value whose sizes fit."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            totals = values[fits] + best[room - sizes[fits]]
            k = int(np.argmax(totals))
            if totals[k] > best[room - 1] + 1e-12:
                best[room], choice[room] = totals[k], fits[k]
                continue
        best[room] = best[room - 1]
    counts, room = np.zeros(len(values), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def column_generation(demand: dict[int, int], capacity: int = UNITS, rounds: int = 3000) -> list[tuple[dict[int, int], float]]:
    """Solves min sum(x) with patterns @ x = demand, x >= 0: (pattern as size -> count, x) of the final basis."""
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0), dtype=np.int64)
    if not len(sizes):
        return []
    want = np.array([demand[s] for s in sizes], dtype=float)
    basis = np.diag(capacity // sizes).astype(float)
    x = want / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        steps = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(steps))
        x = np.maximum(x - steps[out] * change, 0)
        x[out] = steps[out]
        basis[:, out] = column
    return [({int(s): int(n) for s, n in zip(sizes, np.rint(basis[:, j]), strict=True) if n}, float(x[j])) for j in range(len(sizes))]


def patterns(demand: dict[int, int], capacity: int = UNITS) -> list[tuple[dict[int, int], int]]:
    """Whole patterns that use up the demand exactly: the linear program's, rounded down, then largest-first ones for what is left."""
    left = {s: d for s, d in demand.items() if d > 0}
    out = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min(times, *(left.get(s, 0) // n for s, n in pattern.items()))
        if times > 0:
            out.append((pattern, times))
            for s, n in pattern.items():
                left[s] -= n * times

    for pattern, x in sorted(column_generation(demand, capacity), key=lambda p: -p[1]):
        use(pattern, int(x + 1e-6))
    while any(left.values()):
        room, pattern = capacity, {}
        for s in sorted((s for s, d in left.items() if d), reverse=True):
            if n := min(left[s], room // s):
                pattern[s] = n
                room -= n * s
        use(pattern, max(left.values()))
    return out


def power_lengths(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def running(df: DataFrame, name: str, value: F.Column, buckets: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, in the order of (bucket, rid). One small row a bucket is summed up alone."""
    spread = F.pmod(F.xxhash64("rid"), F.lit(buckets))
    df = df.withColumn("_b", spread).withColumn("_v", value)
    sums = df.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_o"))
    inner = F.sum("_v").over(Window.partitionBy("_b").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    return df.join(before, "_b").withColumn(name, (F.col("_o") + inner).cast("long")).drop("_b", "_v", "_o")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, length: int, keep_ids: bool) -> DataFrame:
    """doc_id, n (ids with the end id), h (hash bucket) and the checksums of its pieces of ``length``, or its ids."""
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encoder = shared_encoder(tokenizer)
        for pdf in batches:
            rows = []
            for text in pdf.text:
                ids = encoder.encode(text) + tail
                n = len(ids) // 2
                if keep_ids:
                    rows.append((n, ids))
                else:
                    wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    rows.append((n, [zlib.crc32(wide[i : i + 4 * length]) for i in range(0, 4 * n, 4 * length)]))
            out = pd.DataFrame(rows, columns=["n", "body"])
            out.insert(0, "h", pdf.h.to_numpy())
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield out

    body = "binary" if keep_ids else "array<long>"
    docs = common.text_batches(docs).select(common.id_text(), "text", "h")
    return common.id_long(docs.mapInPandas(run, f"doc_id string, h int, n long, body {body}"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    Null texts are empty: their document is the end id alone. Rows of equal doc_id are packed each for itself; an empty table
    gives no rows; columns other than doc_id and text play no part, whatever their names. A very long text is many whole sequences and one remainder.
    Patterns and the histogram are bounded by UNITS and FILLER_BUCKETS, whatever the input; running sums have a bucket for every 50,000 rows, so no
    class of lengths, however common, is one window.
    """
    spark = docs.sparkSession
    unit = length // UNITS
    folder = common.scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(FILLER_BUCKETS)).cast("int").alias("h"))  # of the row: ids may be one or none
    known = common.written(tokenized(docs, tokenizer, end_id, length, False).withColumn("rid", F.monotonically_increasing_id()), "known", folder)
    rest = F.col("n") % length
    table = known.groupBy("h", F.ceil(rest / unit).cast("int").alias("c")).agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum(rest).alias("r")).collect()
    total = sum(x.n for x in table)
    buckets = int(max(256, sum(x.d for x in table) // 50_000))
    by_bucket = np.zeros(FILLER_BUCKETS, np.int64)
    for x in table:
        by_bucket[x.h] += x.n
    filler_ids = np.concatenate([[0], np.cumsum(by_bucket)])
    k = int(np.searchsorted(filler_ids, 0.015 * total))
    while True:  # until the fillers suffice; with all documents as fillers nothing is left to fill
        k = min(max(k, 1), FILLER_BUCKETS)
        demand: dict[int, int] = {}
        for x in table:
            if x.h >= k and x.c:
                demand[x.c] = demand.get(x.c, 0) + x.d
        plan = patterns(demand)
        n_mixed = sum(times for _, times in plan)
        free = n_mixed * length - sum(x.r for x in table if x.h >= k)
        if filler_ids[k] >= free:
            break
        k = max(k + 1, int(np.searchsorted(filler_ids, 1.02 * free)))
    surplus = int(filler_ids[k]) - free

    # where each class's ranks go: from rank (starts) on, so many (per) to each of the sequences from (base) on
    uses: dict[int, list[tuple[int, int, int]]] = {}
    reached: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        for c, per in pattern.items():
            uses.setdefault(c, []).append((reached.get(c, 0), per, base))
            reached[c] = reached.get(c, 0) + per * times
        base += times
    uses_np = {c: tuple(np.array(x, np.int64) for x in zip(*u, strict=True)) for c, u in uses.items()}

    @F.pandas_udf("long")
    def sequence_of(c: pd.Series, rank: pd.Series) -> pd.Series:
        out, c, rank = np.zeros(len(c), np.int64), c.to_numpy(), rank.to_numpy()
        for one in np.unique(c):
            at = np.flatnonzero(c == one)
            starts, per, first = uses_np[int(one)]
            i = np.searchsorted(starts, rank[at], side="right") - 1
            out[at] = first[i] + (rank[at] - starts[i]) // per[i]
        return pd.Series(out)

    solid = known.filter(F.col("h") >= k)
    whole = solid.filter(F.col("n") >= length).select("rid", "doc_id", "n", F.slice("body", F.lit(1), F.floor(F.col("n") / length).cast("int")).alias("crcs"))
    whole = running(whole, "before", F.size("crcs"), buckets).select("doc_id", "n", "before", F.posexplode("crcs").alias("p", "ids_crc32"))
    n_whole = sum(x.n - x.r for x in table if x.h >= k) // length
    whole = whole.select("doc_id", (F.col("p") * F.lit(length)).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.lit(n_mixed) + F.col("before") + F.col("p")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    mixed = solid.filter(rest > 0).select("rid", "doc_id", "n", rest.alias("r"), F.ceil(rest / unit).cast("int").alias("c"), F.element_at("body", -1).alias("ids_crc32"), F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("b"))
    sizes = mixed.groupBy("c", "b").count()
    ahead = sizes.select("c", "b", (F.sum("count").over(Window.partitionBy("c").orderBy("b")) - F.col("count")).alias("ahead"))
    ranked = mixed.join(ahead, ["c", "b"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("c", "b").orderBy("rid")) - 1)
    placed = ranked.withColumn("sequence_id", sequence_of("c", "rank"))
    within = Window.partitionBy("sequence_id").orderBy("rid")
    placed = common.written(placed.withColumn("offset", F.sum("r").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("r")).select("doc_id", "n", "r", "ids_crc32", "sequence_id", "offset"), "placed", folder)
    mixed_out = placed.select("doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    # the line of free places: s up to e, in the sequence from position `at` on
    used = placed.groupBy("sequence_id").agg(F.sum("r").alias("at")).filter(F.col("at") < length)
    line = running(used.withColumnRenamed("sequence_id", "rid").withColumn("w", F.lit(length) - F.col("at")), "s", F.col("w"), buckets).select(F.col("rid").alias("sequence_id"), "at", "s", (F.col("s") + F.col("w")).alias("e"))
    line = line.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / length), F.floor((F.col("e") - 1) / length))))

    fillers = tokenized(docs.filter(F.col("h") < k), tokenizer, end_id, length, True).withColumn("rid", F.monotonically_increasing_id())
    fillers = common.written(fillers, "fillers", folder)
    along = running(fillers.select("rid", "n"), "a", F.col("n"), buckets).withColumn("z", F.col("a") + F.col("n"))
    along = common.written(along, "along", folder)
    inside = along.filter(F.col("a") < free).select("rid", "a", F.least("z", F.lit(free)).alias("z"))
    inside = inside.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("z") - 1) / length))))
    low, high = F.greatest("a", "s"), F.least("z", "e")
    cut = inside.join(line, "block").filter((low < high) & (F.floor(low / length) == F.col("block")))
    cut = cut.groupBy("rid").agg(F.collect_list(F.struct((low - F.col("a")).alias("start"), (high - low).alias("size"), "sequence_id", (F.col("at") + low - F.col("s")).alias("offset"))).alias("cuts"))
    first_extra = n_mixed + n_whole
    full_extra, tail = divmod(surplus, length)
    ends, starts_at = power_lengths(tail), []
    for size in ends:
        starts_at.append((starts_at[-1][0] + starts_at[-1][1], size) if starts_at else (full_extra * length, size))

    def pieces(batches):
        for pdf in batches:
            rows = []
            for doc_id, n, a, ids, cuts in zip(pdf.doc_id, pdf.n.tolist(), pdf.a.tolist(), pdf.body, pdf.cuts, strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                own = [(c["start"], c["size"], c["sequence_id"], c["offset"]) for c in cuts] if cuts is not None else []
                p, z = max(a, free) - free, a + n - free  # in the extra part of the line
                while p < z:
                    if p < full_extra * length:
                        at, size, number = p // length * length, length, first_extra + p // length
                    else:
                        i = max(j for j, x in enumerate(starts_at) if x[0] <= p)
                        (at, size), number = starts_at[i], first_extra + full_extra + i
                    end = min(z, at + size)
                    own.append((p + free - a, end - p, number, p - at))
                    p = end
                rows += [(doc_id, s, m, zlib.crc32(wide[4 * s : 4 * (s + m)]), n, q, o) for s, m, q, o in sorted(own)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            yield out

    joined = fillers.select("rid", "doc_id", "n", "body").join(along.select("rid", "a"), "rid").join(cut, "rid", "left")
    filled = joined.select(common.id_text(), "n", "a", "body", "cuts").mapInPandas(pieces, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return mixed_out.unionByName(whole).unionByName(common.id_long(filled))
