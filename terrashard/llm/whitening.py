"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. The fit list is each distinct x vector once (map-side combined, so copies
cost nothing). Its sums are exact; the scatter is of centred vectors, summed in each task and over tasks, so what reaches the
driver is one matrix of dimensions x dimensions, whatever the number of rows. There, Jacobi rotations go round all pairs of
dimensions until every off-diagonal entry is negligible beside the geometric mean of its two diagonal entries; that test, and not one
beside the largest entry, is what makes small eigenvalues accurate. The sorted, scaled eigenvectors are sent to the tasks, which
centre and project each row.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one of 2 ** 46 or more, are dropped; of
vectors of several lengths the most frequent length stays (the larger of two). Components are those whose variance is above RANK of the total, so there may
be fewer than asked for, and none where all vectors are equal; those of equal variance are any orthonormal basis, the same for all
rows. A deviation beyond 63 bits is null. Repeated rows and ids are whitened each by itself; an empty table gives an empty one. Only vec_id
and embedding are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Share of the total variance below which a direction counts as empty.
RANK = 1e-13
SWEEPS = 60
#: Entries from here on have no exact x as a double.
LARGEST = 2.0**46
#: Groups over which tasks' matrices are summed first.
GROUPS = 64


@dataclass
class Whitening:
    """n and sums (exact integers) of the fit list, variances (falling, those of the components), their matrix (dimensions x components, already scaled), all variance, and the identity error."""

    n: int
    sums: list[int]
    variances: np.ndarray
    matrix: np.ndarray
    total: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows that have a vector, with x in place of it."""
    c = F.col(vector).cast("array<double>")
    fits = F.coalesce((F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False))), F.lit(False))  # NaN is above all numbers
    return rows.where(fits).withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT)).drop(vector)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def each_task(what):
    """what(matrix) of every batch, summed over a task: part, i, row (a row of the sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                some = what(matrix_of(batch.column("x")))
                total = some if total is None else total + some
        if total is not None:
            part = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["part", "i", "row"])

    return run


def added(pdf: pa.Table) -> np.ndarray:
    return matrix_of(pdf["row"].combine_chunks()).sum(0)


def summed(fit: DataFrame, what) -> np.ndarray:
    """what(matrix) over all of fit: summed in tasks, then over groups of tasks, then over groups."""
    first = lambda t: pa.table({"i": t["i"].slice(0, 1), "row": pa.array([added(t)], pa.list_(pa.float64()))})
    parts = fit.select("x").mapInArrow(each_task(what), "part int, i int, row array<double>")
    rows = parts.groupBy("i", "part").applyInArrow(first, "i int, row array<double>").groupBy("i").applyInArrow(first, "i int, row array<double>").collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, falling, by cyclic Jacobi rotations. RuntimeError if it takes more sweeps."""
    a, n = np.array(matrix, np.float64), len(matrix)
    a = (a + a.T) / 2
    v = np.eye(n)
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= eps * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, h = t * c, t * a[p, q]
                app, aqq = a[p, p] - h, a[q, q] + h
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p] = a[:, p] = c * row_p - s * row_q
                a[q] = a[:, q] = s * row_p + c * row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            order = np.argsort(-np.diag(a), kind="stable")
            return np.diag(a)[order], v[:, order]
    raise RuntimeError(f"rotations haven't ended in {sweeps} sweeps")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (x); None if there are none."""
    distinct = settle(rows.select("x").distinct(), "fit")
    found = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return None
    n, sums = found[0].n, [int(r.s) for r in sorted(found, key=lambda r: r.i)]
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        d = x - mean
        return d.T @ d

    variance = summed(distinct, scatter) / n
    total = float(np.trace(variance))
    values, vectors = jacobi(variance)
    k = min(components, int((values > RANK * total).sum()))
    made = Whitening(n, sums, values[:k], vectors[:, :k] / np.sqrt(values[:k]), total)
    if k:
        whole = made.matrix

        def moments(x: np.ndarray) -> np.ndarray:
            """Scatter and sums of the whitened vectors."""
            z = (x - mean) @ whole
            return np.vstack([z.T @ z, z.sum(0)])

        m = summed(distinct, moments) / n
        made.identity_error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(k)).max())
    discard(distinct)
    return made


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; null beyond 63 bits."""
    s = np.array(sums, object)
    small = n * float(np.abs(x).max()) + float(max(map(abs, sums))) < 2**62
    d = n * x - s.astype(np.int64) if small else n * x.astype(object) - s
    if small and len(sums) * float(np.abs(d).max()) ** 2 < 2**62:
        return (d * d).sum(1).tolist()
    exact = d.astype(object)
    return [v if v < 2**63 else None for v in (exact * exact).sum(1)]


def whitened(rows: DataFrame, model: Whitening, *names: str) -> DataFrame:
    """The named columns of rows (x), deviation, whitened (a number for each component). The matrix, dimensions x components, goes to every task."""
    n, sums, mean, matrix = model.n, model.sums, model.mean, model.matrix
    given = rows.select(*names, "x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in names), "deviation long", "whitened array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("x"))
                z = (x - mean) @ matrix
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(deviation(x, n, sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], [*names, "deviation", "whitened"])

    return given.mapInArrow(run, schema)


def usual_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error; a row for each vector and component."""
    rows = quantised(embeddings.select("vec_id", "embedding"))
    rows = rows.where(F.size("x") == usual_length(rows))
    model = fit(rows, components)
    if model is None or not len(model.variances):
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(e / model.total)) for e in model.variances))
    each: Column = F.posexplode("whitened").alias("i", "z")
    made = whitened(rows, model, "vec_id").select("vec_id", "deviation", each)
    return made.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("z").alias("whitened"), F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
