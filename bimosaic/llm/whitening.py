"""Embedding whitening by shifted CholeskyQR.

Vectors are rounded down to a grid of whole numbers once, so that sums and deviations are exact. The centred rows are then made
orthonormal in passes: a pass adds up the Gram matrix of the rows as they are by now (each task its own rows, the tasks' matrices
by row of the matrix), the driver factors it, and the next pass solves the rows with all triangular factors so far. The first
factorisation is shifted by a multiple of the rounding error, which makes it succeed for any condition; the passes end when the
Gram matrix is the identity to rounding. The product of the factors is R of the centred rows, and its singular values and right
vectors are the components. What reaches the driver is a matrix of the dimension, whatever the number of rows.

Defined cases: vectors that are null or hold null, NaN or infinite entries are left out; entries beyond +-2**46 count as that;
repeated rows count as often as they occur; a null id stays null. Directions without variance (below 1e-12 of a factored Gram
matrix) have no component, so equal vectors, a single one or none give no rows. A deviation beyond a long is null. Vectors of
several lengths raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 52)
#: The passes end when no entry of the Gram matrix is farther than this from the identity, or after so many.
ORTHONORMAL, PASSES = 1e-12, 10
NO_VARIANCE = 1e-12
#: Sums of halves of this many low bits fit a long for up to 2**30 rows.
HALF = 20
Step = tuple[str, np.ndarray]


@dataclass
class Whitening:
    """What ``fit`` learns: n, the exact sums, unit components (by falling eigenvalue), eigenvalues and the covariance's trace."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def steps(self, k: int) -> list[Step]:
        return [("times", (self.components[:k] / np.sqrt(self.eigenvalues[:k, None])).T.copy())]


def on_grid(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, x (array of long): floor(SCALE * entry) + OFFSET for vectors whose entries are all finite."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(c.cast("double")), F.lit(True))
    kept = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v")).filter(F.col("v").isNotNull() & F.forall("v", finite))
    whole = lambda c: F.floor(F.greatest(F.least(SCALE * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + OFFSET
    return kept.select("id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False)
    return x.reshape(len(column), -1) if len(column) else x.reshape(0, 0)


def sums(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """n and each dimension's exact sum, least and greatest value; rows: id, x."""
    lengths = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} entries")
    if not lengths[0]:
        return 0, [], [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            part = [np.full(x.shape[1], len(x)), (x >> HALF).sum(0), (x & ((1 << HALF) - 1)).sum(0), x.min(0), x.max(0)]
            total = part if total is None else [*(p + q for p, q in zip(total[:3], part[:3])), np.minimum(total[3], part[3]), np.maximum(total[4], part[4])]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0]))), *map(pa.array, total)], ["i", "n", "high", "low", "least", "most"])

    parts = rows.select("id", "x").mapInArrow(run, "i long, n long, high long, low long, least long, most long")
    found = sorted(parts.groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low"), F.min("least"), F.max("most")).collect())
    return found[0][1], [(r[2] << HALF) + r[3] for r in found], [r[4] for r in found], [r[5] for r in found]


def _centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x0 and t with n * x - S = n * (x - x0) - t, small numbers."""
    base = [s // n for s in total]
    return np.array(base), np.array([s - n * b for s, b in zip(total, base)])


def _stepped(y: np.ndarray, steps: list[Step]) -> np.ndarray:
    """Rows of y through the steps: times a matrix, or a solve with an upper triangular one from the right."""
    for kind, m in steps:
        if kind == "times":
            y = y @ m
            continue
        q = np.empty_like(y)
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ m[:j, j]) / m[j, j]
        y = q
    return y


def gram(rows: DataFrame, n: int, total: list[int], steps: list[Step]) -> np.ndarray:
    """The Gram matrix of the centred rows after ``steps``."""
    base, rest = _centre(n, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in slices(batches, 4096):
            if b.num_rows:
                y = _stepped((n * (_matrix(b.column(1)) - base).astype(np.float64) - rest) / n, steps)
                out = y.T @ y if out is None else out + y.T @ y
        if out is not None:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(np.full(len(out), task)), pa.array(list(out))], ["i", "task", "g"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("task").combine_chunks()  # the same order of additions on every run
        return pa.table({"i": [key[0].as_py()], "g": pa.array([_matrix(group["g"].chunk(0)).sum(0)], pa.list_(pa.float64()))})

    parts = rows.select("id", "x").mapInArrow(run, "i long, task long, g array<double>")
    return np.array([r[1] for r in sorted(parts.groupBy("i").applyInArrow(add, "i long, g array<double>").collect())])


def fit(rows: DataFrame) -> Whitening | None:
    """Components of the rows (id, x); None where nothing varies."""
    n, total, least, most = sums(rows)
    if n == 0 or least == most:
        return None
    d = len(total)
    g = gram(rows, n, total, [])
    trace = float(np.trace(g)) / n
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.trace(g))
    r = np.linalg.cholesky(g + shift * np.eye(d)).T
    steps: list[Step] = [("solve", r)]
    for _ in range(PASSES):
        g = gram(rows, n, total, steps)
        values, vectors = np.linalg.eigh(g)
        if values[0] < NO_VARIANCE:
            u = vectors[:, values >= NO_VARIANCE]
            steps, r, g = [*steps, ("times", u)], u.T @ r, u.T @ g @ u
        done = np.abs(g - np.eye(len(g))).max() <= ORTHONORMAL
        factor = np.linalg.cholesky((g + g.T) / 2).T
        steps, r = [*steps, ("solve", factor)], factor @ r
        if done:
            break
    _, s, components = np.linalg.svd(r, full_matrices=False)
    return Whitening(n, total, least, most, components, s * s / n, trace)


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for every usable vector and component (from 1)."""
    rows = materialize(on_grid(vectors, id_column, column), "grid")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, k = model.n, min(components, len(model.eigenvalues))
    steps = model.steps(k)
    error = float(np.abs(gram(rows, n, model.sums, steps) / n - np.eye(k)).max())
    explained = model.eigenvalues[:k] / model.trace
    base, rest = _centre(n, model.sums)
    widest = max(max(abs(n * x - s) for x in (a, b)) for a, b, s in zip(model.least, model.most, model.sums))
    fits = widest**2 * len(base) < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            if not b.num_rows:
                continue
            y, m = _matrix(b.column(1)) - base, b.num_rows
            if fits:
                deviation = pa.array(((n * y - rest) ** 2).sum(1))
            else:
                exact = [sum((n * v - int(t)) ** 2 for v, t in zip(row, rest)) for row in y.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            white = _stepped((n * y.astype(np.float64) - rest) / n, steps)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(at),
                 pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
