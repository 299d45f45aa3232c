"""Operator 1: approximate nearest neighbours from balanced posting lists.

A bounded sample is clustered by k-means whose overfull clusters are split, so the lists come out balanced; their number grows with the square root of
the number of vectors. A graph of near neighbours among the centroids stays in memory and is searched best-first. Every distinct vector goes to
its nearest centroid's list, and a boundary vector also to further lists whose centroids are nearly as near, unless one lies too close to a
centroid chosen before. A query searches the lists whose centroids are within a ratio of its nearest one's distance, and further ones until they hold READ vectors.
Lists stop growing in number where the sample ends (at some 32,000 for vectors of 64 components), and grow in length from there on.

The largest inner product becomes the least distance by one more coordinate, which gives all vectors the largest norm and is zero in
queries. Equal vectors are one entry with its least ids, as many as a result can hold. Neighbouring lists are dealt out together, so that a vector travels
once for each such group; groups and their queries are cut into cells of bounded size. A cell scores in double precision the entries that share a list with a
query, and keeps its best by score, then least vec_id: nothing that ties with the last one is cut unseen. The group of a query's nearest list is searched first; its
worst score of the wanted number is a bound below which the cells of all other groups hand nothing on.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import common

TOP, EVERY = 20, 20
#: Lists: so many times the square root of the number of vectors, with LIST vectors or more each; most bytes of the sample that the clustering sees.
LISTS, LIST, SAMPLE_BYTES = 4, 24, 32 << 20
#: A vector goes to at most COPIES lists, within this ratio of the nearest centroid's distance; centroids of one vector differ by this share of their squared distance.
COPIES, BOUNDARY, APART = 4, 1.2, 0.3
#: A query searches the lists within this ratio, and more until they hold so many vectors.
RATIO, READ = 1.17, 1024
#: Neighbours of a centroid in the graph, and the width of the search.
DEGREE, ENTRIES = 24, 32
#: Entries of a group of lists, most entries and queries in one cell, and distances that are held at a time on the driver.
GROUP, CELL, DISTANCES = 8192, 8192, 1 << 22


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, in blocks of a bounded number of distances."""
    step = max(16, DISTANCES // max(1, len(centers)))
    return np.concatenate([squared(x[i : i + step], centers).argmin(1) for i in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of clusters, none over twice the mean size: overfull ones are split in two until they fit."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centers)
        sizes = np.bincount(of, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    out, most = [], max(8, 2 * len(x) // len(centers))
    stack = [x[of == c] for c in range(len(centers)) if (of == c).any()]
    while stack:
        part = stack.pop()
        if len(part) <= most or (part == part[0]).all():
            out.append(part.mean(0))
            continue
        two = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            near = squared(part, two).argmin(1)
            if near.min() == near.max():
                break
            two = np.stack([part[near == 0].mean(0), part[near == 1].mean(0)])
        near = near if near.min() != near.max() else np.arange(len(part)) % 2
        stack += [part[near == 0], part[near == 1]]
    return np.stack(out)


class CentroidGraph:
    """Centroids with the edges to their nearest ones, searched for many vectors at a time."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers.astype(np.float32)
        k = len(centers)
        degree = min(DEGREE, k - 1)
        self.edges = np.zeros((k, degree), np.int64)
        for i in range(0, k, 1024):
            d = squared(self.centers[i : i + 1024], self.centers)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            self.edges[i : i + 1024] = np.argsort(d, axis=1)[:, :degree]
        self.entries = np.random.default_rng(3).choice(k, min(k, max(ENTRIES, int(k**0.5))), replace=False)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``width`` centroids found for each row, nearest first, with squared distances; -1 and inf where fewer were met."""
        x, k = x.astype(np.float32), len(self.centers)
        n, width = len(x), min(width, k)
        seen = np.zeros((n, k), bool)
        ids = np.tile(self.entries, (n, 1))
        seen[np.arange(n)[:, None], ids] = True
        best, dist = self._shorten(ids, squared(x, self.centers[self.entries]), max(width, ENTRIES))
        open_ = np.ones(best.shape, bool)
        norms = (self.centers**2).sum(1)
        own = (x**2).sum(1)
        while True:
            rank = np.where(open_ & (best >= 0), dist, np.inf)
            step = rank.argmin(1)
            live = np.flatnonzero(np.isfinite(rank[np.arange(n), step]))
            if not len(live) or not self.edges.shape[1]:
                break
            at = step[live]
            open_[live, at] = False
            new = self.edges[best[live, at]]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            d = own[live, None] + norms[new] - 2 * np.einsum("nd,nkd->nk", x[live], self.centers[new])
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            all_ids, all_d = np.hstack([best[live], np.where(fresh, new, -1)]), np.hstack([dist[live], d])
            flags = np.hstack([open_[live], fresh])
            order = np.argsort(all_d, axis=1, kind="stable")[:, : best.shape[1]]
            row = np.arange(len(live))[:, None]
            best[live], dist[live], open_[live] = all_ids[row, order], all_d[row, order], flags[row, order]
        return best[:, :width], dist[:, :width]

    @staticmethod
    def _shorten(ids, d, width):
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        pad = width - ids.shape[1]
        return (ids, d) if pad <= 0 else (np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf))

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector is put on, the nearest first."""
        ids, d = self.search(x, 4 * COPIES)
        out = []
        for row, dist in zip(ids, d, strict=True):
            chosen = [int(row[0])]
            for c, dc in zip(row[1:], dist[1:], strict=True):
                if c < 0 or dc > BOUNDARY**2 * dist[0] or len(chosen) >= COPIES:
                    break
                if (((self.centers[chosen] - self.centers[c]) ** 2).sum(1) >= APART * dc).all():
                    chosen.append(int(c))
            out.append(np.array(chosen))
        return out

    def probes(self, x: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The lists that each query searches: those within the ratio, and on down the nearest until they hold READ vectors (``sizes``: vectors nearest to each centroid)."""
        out, left, width = [None] * len(x), np.arange(len(x)), 2 * ENTRIES
        while len(left):
            ids, d = self.search(x[left], width)
            again = []
            for i, row, dist in zip(left, ids, d, strict=True):
                found = row >= 0
                row, dist = row[found], dist[found]
                whole = len(row) >= min(width, len(self.centers))
                if width >= len(self.centers) and not whole:  # the graph didn't reach all centroids
                    every = squared(x[i : i + 1].astype(np.float32), self.centers)[0]
                    row = np.argsort(every, kind="stable")
                    dist = every[row]
                few = np.r_[0, np.cumsum(sizes[row])[:-1]] < READ
                wanted = few | (dist <= RATIO**2 * max(dist[0], 1e-12))
                if wanted.all() and width < len(self.centers):
                    again.append(i)
                else:
                    out[i] = row[wanted]
            left, width = np.array(again, np.int64), 4 * width
        return out


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>, own array): rows that take part; own is the vector as it came."""
    good = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) v").filter(good.replace("embedding", "v"))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def best_of(queries: pd.DataFrame, entries: pd.DataFrame, top: int) -> pd.DataFrame:
    """One row a query: its ``top`` entries among those that share a list with it and reach its ``bound``, by exact score and then least id, as arrays."""
    found = []
    if len(queries) and len(entries):
        x, q = stacked(entries.v), stacked(queries.v)
        names = np.unique(np.concatenate([*queries.lists, *entries.lists]))

        def incidence(lists) -> np.ndarray:
            out = np.zeros((len(lists), len(names)), np.float32)
            out[np.repeat(np.arange(len(lists)), [len(k) for k in lists]), np.searchsorted(names, np.concatenate(list(lists)))] = 1
            return out

        low = np.array([i[0] for i in entries.ids])
        asked, held = incidence(queries.lists), incidence(entries.lists)
        keys, bounds = queries.key.to_numpy(), queries.bound.to_numpy()
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ x.T
            rough[asked[at : at + 256] @ held.T == 0] = -np.inf
            m = min(top, len(x))
            least = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
            slack = 1e-9 * (1 + np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(1))
            for i, row in enumerate(rough):
                chosen = np.flatnonzero(np.isfinite(row) & (row >= least[i] - slack[i]))
                exact = (x[chosen] * q[at + i]).sum(1)  # one order of summation wherever a pair is scored
                order = np.lexsort((low[chosen], -exact))[:m]
                order = order[exact[order] >= bounds[at + i]]
                if len(order):
                    found.append((keys[at + i], [entries.ids.iloc[j] for j in chosen[order]], exact[order]))
    return pd.DataFrame(found, columns=["query", "ids", "scores"])


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` the ``top`` rows of largest inner product found.

    Vectors that are null, empty, zero or hold a null or non-finite component, rows with a null vec_id, and vectors of another
    length than the most frequent (ties: the longest) take no part. A row repeated with its vec_id and vector counts once; one vec_id with several vectors
    is several candidates and queries, and none of them finds its own vec_id (so one with over ``top`` vectors of its own may find fewer). Ties go to the smaller
    vec_id among what is read. An empty table gives no rows; other columns play no part.
    """
    return found_by(index(vectors, top, every), top, every)


class Index:
    """What ``index`` leaves: written tables and the counts that say how much was copied and pruned."""

    def __init__(self, **parts):
        self.__dict__ |= parts

    def figures(self) -> dict[str, float]:
        """lists, copies of a vector, lists that a query reads on average, and their share of all lists."""
        one = lambda df: df.agg(F.sum(F.size("lists"))).first()[0] or 0
        read = one(self.probes) / max(1, self.entries.filter("asked").count())
        return {"vectors": self.n, "lists": self.lists, "copies": one(self.postings) / max(1, self.n), "read": read, "share": read / self.lists}


def index(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> Index | None:
    """Posting lists of ``vectors`` and the lists that each query reads; None if no vector takes part."""
    spark = vectors.sparkSession
    folder = common.scratch(spark)
    rows = valid(vectors)
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return None
    width, largest = widths[0].d, widths[0].m
    rows = common.written(rows.filter(F.size("v") == width).dropDuplicates(["vec_id", "v"]), "rows", folder)
    # the least ids of each vector: a group limit before the shuffle bounds what a repeated vector sends
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= top + 1)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("v").agg(F.count("*").alias("n"), F.lit(True).alias("asked"))
    entries = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(asked, "v", "left")
    entries = common.written(entries.withColumn("key", F.monotonically_increasing_id()), "entries", folder)
    n = entries.count()
    bound = int(max(1, min(n, SAMPLE_BYTES // (8 * width))))
    share = F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) <= int(min(1.0, bound / n) * (1 << 30))
    sample = stacked(entries.filter(share).select("v").toPandas().v)
    if not len(sample):
        sample = stacked(entries.limit(1).select("v").toPandas().v)

    def lifted(x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
        return np.hstack([x, more[:, None]])

    graph = CentroidGraph(kmeans(lifted(sample), int(max(1, min(LISTS * isqrt(n), n // LIST, len(sample) // 2)))))
    near = kmeans(graph.centers.astype(float), max(1, min(len(graph.centers), n * COPIES // GROUP)))
    group_of = nearest(graph.centers, near.astype(np.float32))
    shared = spark.sparkContext.broadcast((graph, group_of))  # no more centroids than the sample has vectors

    def dealt(batches, lists_of):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                first, groups = [], []
                for own in lists_of(stacked(part.v)):
                    g = shared.value[1][own]
                    first.append(int(own[0]))
                    groups.append([{"g": int(k), "lists": own[g == k].tolist(), "near": bool(k == g[0])} for k in np.unique(g)])
                yield part.assign(first=first, groups=groups)

    def post(batches):
        yield from dealt(batches, lambda v: shared.value[0].lists_of(lifted(v)))

    def probe(batches):
        yield from dealt(batches, lambda v: shared.value[0].probes(lifted(v, True), sizes))

    grouped = "first int, groups array<struct<g: int, lists: array<int>, near: boolean>>"
    postings = common.written(entries.select("key", "ids", "v").mapInPandas(post, f"key long, ids array<long>, v array<double>, {grouped}"), "placed", folder)
    sizes = np.zeros(len(graph.centers), np.int64)  # each vector once, on its first list
    for row in postings.groupBy("first").agg(F.count("*").alias("m")).collect():
        sizes[row["first"]] = row.m
    postings = postings.select("key", "ids", "v", F.inline("groups")).drop("near")
    probes = entries.filter("asked").select("key", "v").mapInPandas(probe, f"key long, v array<double>, {grouped}").select("key", "v", F.inline("groups"))
    return Index(rows=rows, entries=entries, postings=postings, probes=common.written(probes, "probes", folder), n=n, lists=len(graph.centers), folder=folder, spark=spark)


def found_by(built: Index | None, top: int, every: int) -> DataFrame:
    """The results of an index' queries: cells of a group's entries and queries, then each query's best of all its cells."""
    if built is None:
        return SparkSession.active().createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, entries, postings, probes = built.rows, built.entries, built.postings, built.probes
    # crowded groups, and groups with many queries, are cut into cells of bounded size
    parts = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    cut = F.broadcast(parts(postings, "np").join(parts(probes, "nq"), "g"))  # one row a group

    def dealt(df: DataFrame, mine: str, others: str, a: str, b: str) -> DataFrame:
        own = df.columns
        df = df.join(cut, "g").withColumn(a, F.pmod(F.xxhash64("key"), F.col(mine)).cast("int"))
        return df.withColumn(b, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select(*own, "a", "b")

    def searched(asking: DataFrame, name: str) -> DataFrame:
        """(query, ids, scores): what the cells of these queries (key, v, g, lists, bound) hand on, a row a cell and query."""
        cells = dealt(asking, "nq", "np", "b", "a").groupBy("g", "a", "b").cogroup(dealt(postings, "np", "nq", "a", "b").groupBy("g", "a", "b"))
        return common.written(cells.applyInPandas(lambda queries, own: best_of(queries, own, top + 1), "query long, ids array<array<long>>, scores array<double>"), name, built.folder)

    lowest = F.lit(float("-inf"))
    first = searched(probes.filter("near").drop("near").withColumn("bound", lowest), "nearest")
    # the cells of a query's nearest group, at most top + 1 scores each; fewer in all leave it without a bound
    bounds = first.select("query", F.explode("scores").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s")))).filter(F.col("r") == top + 1)
    asking = probes.filter("NOT near").drop("near").join(bounds.select(F.col("query").alias("key"), F.col("s").alias("bound")), "key", "left")
    others = searched(asking.withColumn("bound", F.coalesce("bound", lowest)), "further")
    pairs = first.unionByName(others).select("query", F.inline(F.arrays_zip("ids", "scores"))).withColumn("low", F.col("ids")[0])
    pairs = pairs.groupBy("query", "ids", "low").agg(F.max("scores").alias("score"))  # an entry may lie in several groups
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    pairs = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top + 1).select("query", "score", F.explode("ids").alias("vec_id"))
    results = pairs.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))  # at most (top + 1) squared
    named = common.written(entries.filter("asked").select("v", "key", "n").join(results, F.col("key") == F.col("query")).select("v", "found", "n"), "found", built.folder)
    questions = rows.filter(F.col("vec_id") % every == 0)
    met = common.joined(questions, named, ["v"], rows.count()).select(F.col("vec_id").alias("query_id"), "found")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return met.select("query_id", F.posexplode(own).alias("r", "x")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def recall(found: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray, top: int = TOP, every: int = EVERY) -> float:
    """Share of the exact ``top`` that ``found`` holds, by brute force over all queries in blocks."""
    hits = total = 0
    own = found.groupby("query_id").vec_id.agg(set).to_dict()
    for i in np.flatnonzero(ids % every == 0):
        s = vectors @ vectors[i]
        s[i] = -np.inf
        exact = ids[np.lexsort((ids, -s))[: min(top, len(ids) - 1)]]
        hits += len(own.get(int(ids[i]), set()) & set(exact.tolist()))
        total += len(exact)
    return hits / max(1, total)
