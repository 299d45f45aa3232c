"""Operator 11: whitening of embeddings by matrix-free block Lanczos with full reorthogonalisation.

The covariance is never formed. A step sends a block of directions to the tasks, which multiply their centred rows with it and back
(XᵀXv), and Spark adds up the products: one number for each dimension and direction comes to the driver, whatever the number of rows. Each new block is
made orthogonal to all before it, twice. Directions that vanish (a breakdown) are replaced by random ones, orthogonal to all others, so that
multiple and missing eigenvalues are found. A basis that grows to BASIS blocks restarts from its best Ritz vectors. The steps end when the
true residuals of all wanted components are rounding noise, or when the basis spans the whole space.

Entries become integers, so sums, means and deviations are exact. The trace of the covariance is the sum of the fitted rows' deviations,
which gives each component's share of the variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT; beyond LIMIT it stays at LIMIT, where doubles have no fractions left.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 53
#: Directions of a block, and the blocks of a basis after which it restarts.
BLOCK, BASIS = 16, 16
#: A residual over the largest eigenvalue that is rounding noise; one that is good enough once residuals don't fall any more; the least eigenvalue, as a share, that isn't zero.
NOISE, ENOUGH, ZERO, STEPS = 1e-14, 1e-11, 1e-12, 400


def numbered(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the rows that take part, written, and the length of their vectors (0: none)."""
    finite = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    whole = f"transform(embedding, c -> greatest({-LIMIT}L, least({LIMIT}L, floor({SCALE} * c))) + {SHIFT}L)"
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").filter(finite)
    rows = common.written(rows.selectExpr("vec_id", f"{whole} x"), "numbered")
    widths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return (rows.filter(F.size("x") == widths[0].d), widths[0].d) if widths else (rows, 0)


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added(rows: DataFrame, compute: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all ``rows`` of the matrices (of ``shape``) that ``compute`` makes of a batch's vectors. A task sends one row for each line of the matrix."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += compute(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "own"])

    lines = rows.select("x").mapInArrow(run, "line int, own array<double>").select("line", F.posexplode("own").alias("place", "v"))
    out = np.zeros(shape)
    for r in lines.groupBy("line", "place").agg(F.sum("v").alias("v")).collect():  # dimensions times directions
        out[r.line, r.place] = r.v
    return out


class Fit:
    """What is fitted on the distinct vectors: ``n``, exact ``sums``, ``vectors`` (a column a component), ``values``, ``explained``, ``steps``."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums])
        self.rest = np.array([(s % n) / n for s in sums])
        #: no deviation of a fitted row is larger
        self.bound = sum(max((n * a - s) ** 2, (n * b - s) ** 2) for a, b, s in zip(low, high, sums, strict=True))
        self.vectors, self.values, self.explained, self.steps = np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list:
        """The exact sums of (n * x - S) ** 2."""
        if self.bound < 1 << 63:
            y = self.n * (x - self.whole) - np.array([s % self.n for s in self.sums])
            return (y * y).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, least: float) -> np.ndarray:
    """``block`` made orthonormal and orthogonal to ``basis``; columns shorter than ``least`` afterwards give way to random ones while the space has room."""
    found = np.zeros((len(block), 0))
    for column in block.T:
        for attempt in range(4):
            v, size = column, np.linalg.norm(column)
            for _ in range(2):
                for q in (basis, found):
                    v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left > (least if not attempt else 1e-8 * size):
                v = v / left
                for q in (basis, found):
                    v = v - q @ (q.T @ v)
                found = np.hstack([found, (v / np.linalg.norm(v))[:, None]])
                break
            if basis.shape[1] + found.shape[1] >= len(block):
                return found
            column = rng.standard_normal(len(block))
    return found


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, count: int, block: int = BLOCK, most: int = BASIS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``count`` largest eigenvalues and unit eigenvectors of the symmetric operator ``multiply``, and the products taken."""
    rng = np.random.default_rng(seed)
    q, aq, steps, best, stuck = np.zeros((d, 0)), np.zeros((d, 0)), 0, np.inf, 0
    new = orthonormal(rng.standard_normal((d, min(block, d))), q, rng, 0.0)
    while True:
        product = multiply(new)
        steps += 1
        q, aq = np.hstack([q, new]), np.hstack([aq, product])
        t = q.T @ aq
        values, s = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)
        values, s = values[order], s[:, order]
        wanted = min(count, d)
        scale = max(abs(values).max(), np.finfo(float).tiny)
        worst = np.linalg.norm(aq @ s[:, :wanted] - (q @ s[:, :wanted]) * values[:wanted], axis=0).max() / scale if len(values) >= wanted else np.inf
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if q.shape[1] >= d or worst <= NOISE or (worst <= ENOUGH and stuck >= 3):
            return values[:wanted], np.linalg.qr(q @ s[:, :wanted])[0], steps
        if steps >= STEPS:
            raise ArithmeticError(f"no convergence after {steps} passes: residual {worst:.2g}")
        following = product - q @ (q.T @ product)
        if q.shape[1] + block > max(most * block, 2 * wanted + block):
            q, aq = q @ s[:, : wanted + block], aq @ s[:, : wanted + block]
        new = orthonormal(following, q, rng, 1e-12 * scale)[:, : d - q.shape[1]]


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """The components of the distinct vectors of ``rows``, and those vectors as a written table."""
    distinct = common.written(rows.select("x").distinct(), "distinct")
    sums = distinct.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    out = Fit(sums[0].n, [int(r.s) for r in sums], [r.low for r in sums], [r.high for r in sums])

    def shares(x):
        return np.array([[float(sum(out.deviations(x)))]])

    trace = added(distinct, shares, (1, 1))[0, 0] / float(out.n) ** 3

    def multiply(v):
        def both(x):
            y = out.centred(x)
            return y.T @ (y @ v)

        return added(distinct, both, v.shape) / out.n

    if trace > 0:
        values, vectors, out.steps = lanczos(multiply, d, components)
        real = values > ZERO * max(values[0], trace / d)
        out.values, out.vectors, out.explained = values[real], vectors[:, real], values[real] / trace
    return out, distinct


def identity_error(found: Fit, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance minus the identity, measured by one more pass."""
    k = len(found.values)

    def products(x):
        w = found.whitened(x)
        return np.vstack([w.T @ w, w.sum(0)])

    total = added(distinct, products, (k + 1, k)) / found.n
    return float(abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and eigenvalue: a row for each vector that takes part and each component.

    Null and empty vectors, ones with null or non-finite entries, and vectors of another length than the most frequent (ties: the longest) take no part. Repeated rows
    each get their rows; equal vectors are fitted once. A null vec_id stays null. Components whose eigenvalue is zero (of n
    distinct vectors at most n - 1 are not) can't be whitened and have no rows, so an empty table, or one with a single distinct vector, gives none. A
    deviation that no long can hold is null. Entries beyond 2 ** 53 in size stay there. Other columns play no part.
    """
    rows, d = numbered(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    found, distinct = fit(rows, d, components)
    if not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(found, distinct)

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                own = [v if v < 1 << 63 else None for v in found.deviations(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.array(list(found.whitened(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    pairs = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    by_component = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), F.col("at") + 1)
    return pairs.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", by_component(found.explained).alias("explained"), F.lit(error).alias("identity_error"), by_component(found.values).alias("eigenvalue"))
