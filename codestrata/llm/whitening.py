"""Whitening of embedding vectors by an exact centred scatter and its triangular factor.

Entries become whole numbers, so counts, sums and the scatter around whole-number centres
are exact, whatever the order of the tasks; the rest of the centring is done on those exact
numbers before one rounding to doubles. A pivoted Cholesky factor of that covariance shows
its rank, and one-sided Jacobi rotations make the columns of the factor orthogonal: their
norms are the roots of the eigenvalues and the normalised columns are the components. Each
task sends one row per pair of dimensions, the driver holds ``dims x dims`` numbers.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
left out; so are vectors of another length than the commonest one (the longest of equally
common ones). Entries count as at most 2**48 / 1024 in size. Components whose
eigenvalue is under 2**-40 of the largest variance have no direction that can be scaled and
are left out, so equal vectors and single rows give no components. A deviation beyond a
64-bit number is null. Repeated ids and rows are rows of their own, null ids stay null, an
empty table gives no rows, and only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
MOST = float(1 << 48)
RANK = 2.0**-40
# The driver factors a matrix of this many rows and columns at most.
MOST_DIMS = 4096
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Whitening:
    """Centre, components and eigenvalues of a fit list of ``n`` vectors.

    The mean of dimension ``k`` is ``centre[k] + rest[k] / n`` exactly.
    """

    n: int
    centre: tuple[int, ...]
    rest: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.centre)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``(id, v)``: the rows with finite vectors, as doubles."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) <= F.lit(1.7976931348623157e308), F.lit(False)))
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def fit(df: DataFrame, vector: str, most: int = 8) -> Whitening | None:
    """The whitening of all usable vectors, with up to ``most`` components; None without vectors."""
    rows = usable(df, vector, vector)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    dims, n = common["d"], common["count"]
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions make a scatter that the driver does not hold; at most {MOST_DIMS}")
    vectors = rows.where(F.size("v") == dims).select("v")
    sums = _added(vectors, _sums(dims))
    total = [sums[k, k] for k in range(dims)]
    centre = tuple((2 * s + n) // (2 * n) for s in total)
    rest = tuple(s - n * c for s, c in zip(total, centre))
    scatter = _added(vectors, _scatter(centre))
    covariance = np.zeros((dims, dims))
    for (i, j), q in scatter.items():
        covariance[i, j] = covariance[j, i] = (n * q - rest[i] * rest[j]) / (n * n)
    trace = sum(n * scatter[k, k] - rest[k] ** 2 for k in range(dims)) / (n * n)
    values, components = eigen(covariance)
    values, components = values[:most], components[:most]
    return Whitening(n, centre, rest, components, values, values / trace if trace else values)


def whiten(df: DataFrame, model: Whitening, id: str, vector: str) -> DataFrame:
    """``(id, deviation, whitened)`` for each usable row; ``whitened`` is an array of doubles.

    ``deviation`` is the squared distance from the mean times ``n`` squared.
    """
    rows = usable(df, id, vector).where(F.size("v") == model.dims)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_whitened(model), f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id)


def identity_error(df: DataFrame, model: Whitening, vector: str) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.eigenvalues)
    sums = _added(usable(df, vector, vector).where(F.size("v") == model.dims).select("v"), _moments(model), "double")
    mean = np.array([sums[-1, j] for j in range(k)]) / model.n
    cov = np.array([[sums[i, j] for j in range(k)] for i in range(k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a covariance matrix and, as rows, their unit eigenvectors.

    The sign of a vector makes its entry of largest size positive.
    """
    factor = rotated(pivoted_cholesky(matrix))
    squares = (factor * factor).sum(0)
    order = np.argsort(-squares, kind="stable")
    vectors = (factor[:, order] / np.sqrt(squares[order])).T
    if vectors.size:
        largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
        vectors = vectors * np.sign(largest)[:, None]
    return squares[order], vectors


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``G`` with ``G @ G.T`` equal to the matrix and as many columns as it has rank.

    Its rows in the order of the pivots are lower triangular.
    """
    left = np.diag(matrix).astype(float).copy()
    columns: list[np.ndarray] = []
    least = RANK * left.max(initial=0.0)
    while len(columns) < len(left):
        pivot = int(left.argmax())
        if left[pivot] <= least:
            break
        done = np.array(columns).reshape(len(columns), len(left))
        column = (matrix[pivot] - done[:, pivot] @ done) / np.sqrt(left[pivot])
        column[left == -np.inf] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        columns.append(column)
        left = left - column * column
        left[pivot] = -np.inf
    return np.array(columns).reshape(len(columns), len(left)).T


def rotated(factor: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: the factor times rotations that make its columns orthogonal."""
    g = factor.copy()
    count = g.shape[1]
    ring = list(range(count + count % 2))
    for _ in range(60):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < count]
            p, q = np.array(pairs, dtype=int).reshape(-1, 2).T
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            skew = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, float(skew.max(initial=0.0)))
            move = np.flatnonzero(skew > 1e-16)
            p, q, a, b, c = p[move], q[move], a[move], b[move], c[move]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = 1 / np.sqrt(1 + t * t)
            gp, gq = g[:, p].copy(), g[:, q].copy()
            g[:, p], g[:, q] = cos * gp - cos * t * gq, cos * t * gp + cos * gq
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 1e-15:
            break
    return g


def _added(rows: DataFrame, partial, kind: str = "decimal(38,0)") -> dict[tuple[int, int], int | float]:
    parts = rows.mapInArrow(partial, f"i int, j int, s {kind}").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r["i"], r["j"]): r["s"] if kind == "double" else int(r["s"]) for r in parts.collect()}


def numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    entries = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64) + OFFSET


def _emitted(sums: dict[tuple[int, int], int | float], kind: pa.DataType) -> pa.RecordBatch:
    i, j = (pa.array([key[at] for key in sums], pa.int32()) for at in (0, 1))
    values = [float(s) for s in sums.values()] if kind == pa.float64() else [int(s) for s in sums.values()]
    return pa.RecordBatch.from_arrays([i, j, pa.array(values, pa.float64()) if kind == pa.float64() else pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "s"])


def _sums(dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, dtype=object)
        for batch in batches:
            x = numbers(batch, dims)
            for at in range(0, len(x), ROWS_AT_ONCE):
                total = total + x[at : at + ROWS_AT_ONCE].sum(0).astype(object)
        yield _emitted({(k, k): s for k, s in enumerate(total)}, pa.decimal128(38, 0))

    return run


def _scatter(centre: tuple[int, ...]):
    def products(y: np.ndarray) -> np.ndarray:
        # Products of doubles are exact while their sums stay under 2**53.
        if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0**53:
            return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
        return y.T.astype(object) @ y.astype(object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, dims = np.array(centre), len(centre)
        total = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            y = numbers(batch, dims) - shift
            for at in range(0, len(y), ROWS_AT_ONCE):
                total = total + products(y[at : at + ROWS_AT_ONCE])
        yield _emitted({(i, j): total[i, j] for i in range(dims) for j in range(i + 1)}, pa.decimal128(38, 0))

    return run


def _projected(model: Whitening, y: np.ndarray) -> np.ndarray:
    centred = (y.astype(float) * model.n - np.array(model.rest, dtype=float)) / model.n
    return centred @ model.components.T / np.sqrt(model.eigenvalues)


def _whitened(model: Whitening):
    def deviations(y: np.ndarray) -> list[int | None]:
        reach = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.rest))
        if reach * reach * model.dims < 1 << 63:
            z = y * model.n - np.array(model.rest)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * model.n - np.array(model.rest, dtype=object)
        return [s if s < 1 << 63 else None for s in (z * z).sum(1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, k = np.array(model.centre), len(model.eigenvalues)
        for batch in batches:
            y = numbers(batch, model.dims) - shift
            offsets = pa.array(np.arange(0, k * len(y) + 1, k, dtype=np.int32) if k else np.zeros(len(y) + 1, np.int32))
            arrays = pa.ListArray.from_arrays(offsets, pa.array(_projected(model, y).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(y), pa.int64()), arrays], names=["id", "deviation", "whitened"])

    return run


def _moments(model: Whitening):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, k = np.array(model.centre), len(model.eigenvalues)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(model, numbers(batch, model.dims) - shift)
            sums, products = sums + w.sum(0), products + w.T @ w
        yield _emitted({(-1, j): s for j, s in enumerate(sums)} | {(i, j): products[i, j] for i in range(k) for j in range(k)}, pa.float64())

    return run
