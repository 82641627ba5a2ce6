"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are fixed-point numbers, floor(64 entry), so sums and products are whole numbers that Spark adds up
exactly, in any order: first the vectors' sums, then the scatter around the rounded mean, of which the
rounding is taken off exactly. Each task sends one row for each cell; what reaches the driver is one matrix
of the vectors' dimensions, whatever the number of rows. There the scatter is factored, C = L L^T with the
largest remaining diagonal first, and L's columns are rotated until they are orthogonal: their squared
norms are the eigenvalues of C, and the normalised columns its unit eigenvectors.

Rows whose vector is null or has a null or non-finite entry are left out. Vectors shorter than the longest
are filled with zeros. Repeated rows count and come back each; an id may be null. Components beyond the
rank of the scatter don't exist: equal vectors, a single one or an empty table give no rows. Eigenvalues
that are equal have components in any order. Entries are to be within 2^30.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import bounded_batches
from boutflow.llm.vectors import dimensions, is_usable, scaled

#: Fixed-point steps to one, and what is added to an entry; whitening doesn't depend on the latter.
SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    n: int
    dims: int
    middle: np.ndarray  # rounded means of floor(SCALE entry), longs
    rest: np.ndarray  # sums of what is left after taking them off, longs
    components: np.ndarray  # dims x k, unit columns
    eigenvalues: np.ndarray  # k, falling
    trace: float

    def centred(self, column: pa.Array) -> np.ndarray:
        return scaled(column, self.dims, SCALE) - self.middle

    def whitened(self, near: np.ndarray) -> np.ndarray:
        return (near - self.rest / self.n) @ (self.components / np.sqrt(self.eigenvalues))


def _cell_sums(rows: DataFrame, vector: str, kind: str, cells: Callable[[pa.Array], np.ndarray]) -> dict[int, float]:
    """Sums, over all rows, of the cells that each batch of vectors gives; a task sends a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = cells(batch.column(vector))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    parts = rows.select(vector).mapInArrow(run, f"cell int, v {kind}")
    return {r.cell: r.total for r in parts.groupBy("cell").agg(F.sum("v").alias("total")).collect()}


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L with L L^T = ``c``, a column for each pivot above rounding; rows are in the order of ``c``, so L is triangular up to their order."""
    c = c.astype(float)
    d, left, columns = len(c), np.diag(c).copy(), []
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for _ in range(d):
        p = int(np.argmax(left))
        if left[p] <= least:
            break
        column = c[:, p] - sum((x * x[p] for x in columns), np.zeros(d))
        column = column / np.sqrt(left[p])
        column[left == -np.inf] = 0.0
        columns.append(column)
        left = left - column**2
        left[p] = -np.inf
    return np.array(columns).T.reshape(d, len(columns))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until each pair is orthogonal to rounding; longest columns first."""
    a, small = factor.T.copy(), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        still = True
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                x, y, xy = a[p] @ a[p], a[q] @ a[q], a[p] @ a[q]
                if abs(xy) <= small * np.sqrt(x * y):
                    continue
                still, z = False, (y - x) / (2 * xy)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                a[p], a[q] = cos * (a[p] - t * a[q]), cos * (a[q] + t * a[p])
        if still:
            break
    return a[np.argsort(-(a**2).sum(axis=1), kind="stable")].T


def fit(rows: DataFrame, k: int = 32, vector: str = "embedding") -> Whitening | None:
    """The first ``k`` components over all usable vectors of ``rows``; None where there are none."""
    bounded_batches(rows.sparkSession)
    rows = rows.where(is_usable(F.col(vector))).select(vector)
    dims = dimensions(rows, vector)
    if not dims:
        return None
    sums = _cell_sums(rows, vector, "long", lambda column: np.append(scaled(column, dims, SCALE).sum(axis=0), len(column)))
    n = sums[dims]
    middle = np.array([(2 * sums[i] + n) // (2 * n) for i in range(dims)])
    rest = [sums[i] - n * int(middle[i]) for i in range(dims)]
    upper = np.triu_indices(dims)

    def products(column: pa.Array) -> np.ndarray:
        near = scaled(column, dims, SCALE) - middle
        return (near.T @ near)[upper]

    found = _cell_sums(rows, vector, "long", products)
    scatter = np.zeros((dims, dims))
    for cell, (i, j) in enumerate(zip(*upper, strict=True)):
        scatter[i, j] = scatter[j, i] = (n * found[cell] - rest[i] * rest[j]) / n  # whole numbers up to the division
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((rotated**2).sum(axis=0))
    if not len(norms):
        return None
    take = min(k, len(norms))
    return Whitening(n, dims, middle, np.array(rest, np.int64), rotated[:, :take] / norms[:take], norms[:take] ** 2 / n, float(np.trace(scatter)) / n)


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all usable rows."""
    k = len(model.eigenvalues)
    upper = np.triu_indices(k)

    def products(column: pa.Array) -> np.ndarray:
        white = model.whitened(model.centred(column))
        return (white.T @ white)[upper]

    bounded_batches(rows.sparkSession)
    found = _cell_sums(rows.where(is_usable(F.col(vector))), vector, "double", products)
    return max(abs(found[cell] / model.n - float(i == j)) for cell, (i, j) in enumerate(zip(*upper, strict=True)))


def _deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null beyond a long."""
    if y.size and float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0**62:
        totals = [sum(int(v) ** 2 for v in row) for row in y]
        return [t if t < 1 << 63 else None for t in totals]
    return (y * y).sum(axis=1).tolist()


def whiten(rows: DataFrame, model: Whitening | None, error: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType(
        [rows.schema[id_col]] + [T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]
    )
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, b = model.centred(batch.column(vector)), batch.num_rows
            which = np.repeat(np.arange(b), k)
            deviation = pa.array(_deviations(model.n * near - model.rest), pa.int64())
            columns = [
                batch.column(id_col).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, model.n)), deviation.take(pa.array(which)),
                pa.array(model.whitened(near).reshape(-1)), pa.array(np.tile(model.eigenvalues / model.trace, b)), pa.array([error] * (b * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    bounded_batches(rows.sparkSession)
    return rows.where(is_usable(F.col(vector))).select(id_col, vector).mapInArrow(run, schema)
