"""Iterative linear solvers: numpy kernels, one matrix a task, and a form over tables for one huge matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import matrix as m
from quillon.operators.grouped import dealt, groups


@dataclass
class Coo:
    """Coordinates of one matrix in memory; products are O(entries)."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n_rows: int
    n_cols: int

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * x[self.col], self.n_rows)

    def transpose_times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * x[self.row], self.n_cols)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n_rows, self.n_cols))
        np.add.at(out, (self.row, self.col), self.value)
        return out


def _shape(a: Coo, b: np.ndarray, guess: np.ndarray | None) -> np.ndarray:
    if len(b) != a.n_rows:
        raise ValueError(f"right-hand side has {len(b)} entries, the matrix {a.n_rows} rows")
    if guess is not None and len(guess) != a.n_cols:
        raise ValueError(f"guess has {len(guess)} entries, the matrix {a.n_cols} columns")
    return np.zeros(a.n_cols) if guess is None else guess.astype(float).copy()


def conjugate_gradient(a: Coo, b: np.ndarray, *, most: int = 1000, tol: float = 1e-10, guess: np.ndarray | None = None, strict: bool = False, jacobi: bool = False) -> tuple[np.ndarray, int, float]:
    """(x, iterations, residual norm) for a square symmetric positive matrix.

    Ends once the residual's norm is below ``tol``.  A direction of no curvature raises in strict mode,
    for an exact guess too, and ends the run otherwise.
    """
    if a.n_rows != a.n_cols:
        raise ValueError("conjugate gradient needs a square matrix")
    x = _shape(a, b, guess)
    scale = np.ones(len(b))
    if jacobi:
        diagonal = np.bincount(a.row[a.row == a.col], a.value[a.row == a.col], a.n_rows)
        scale = np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 1.0)
    r = b - a.times(x)
    z = scale * r
    p, rz = z.copy(), float(r @ z)
    done = 0
    if not strict and np.sqrt(r @ r) < tol:
        return x, 0, float(np.sqrt(r @ r))
    for _ in range(most):
        ap = a.times(p)
        curve = float(p @ ap)
        if curve == 0:
            if strict:
                raise ArithmeticError("direction without curvature")
            break
        alpha = rz / curve
        x += alpha * p
        r -= alpha * ap
        done += 1
        if np.sqrt(r @ r) < tol:
            break
        z = scale * r
        new = float(r @ z)
        p = z + (new / rz) * p
        rz = new
    return x, done, float(np.sqrt(r @ r))


def conjugate_gradients(a: np.ndarray, b: np.ndarray, *, most: int, tol: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, residual norms) of a stack of small dense systems, by the steps of ``conjugate_gradient`` with ``jacobi``; each ends on its own."""
    dot = lambda u, v: np.einsum("ki,ki->k", u, v)
    diagonal = np.einsum("kii->ki", a)
    scale = np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 1.0)
    x, left = guess.copy(), np.empty(len(b))
    r = b - np.einsum("kij,kj->ki", a, x)
    now, y, z = np.arange(len(b)), x.copy(), scale * r
    p, rz = z.copy(), dot(r, z)
    left[:] = np.sqrt(dot(r, r))
    live = left >= tol
    for _ in range(most):
        if not live.all():
            x[now[~live]], left[now[~live]] = y[~live], np.sqrt(dot(r, r))[~live]
            now, a, y, r, p, rz, scale, tol = (v[live] for v in (now, a, y, r, p, rz, scale, tol))
        if not len(now):
            break
        ap = np.einsum("kij,kj->ki", a, p)
        curve = dot(p, ap)
        ends = curve == 0
        alpha = np.where(ends, 0.0, rz / np.where(ends, 1.0, curve))
        y = y + alpha[:, None] * p
        r = r - alpha[:, None] * ap
        live = ~ends & (np.sqrt(dot(r, r)) >= tol)
        z = scale * r
        new = dot(r, z)
        p = z + (new / np.where(live, rz, 1.0))[:, None] * p
        rz = new
    x[now], left[now] = y, np.sqrt(dot(r, r))
    return x, left


def least_squares(a: Coo, b: np.ndarray, *, most: int = 10_000, tol: float = 1e-9, guess: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """(x, iterations, norm of A'(b - A x)) for any shape, by conjugate gradient on the normal equations.

    Ends once that norm is below ``tol``, or silently where a step breaks down; with fewer equations than
    unknowns the solution nearest the guess comes out.
    """
    x = _shape(a, b, guess)
    s = a.transpose_times(b - a.times(x))
    p, gamma, done = s.copy(), float(s @ s), 0
    while done < most and np.sqrt(gamma) >= tol:
        ap = a.times(p)
        curve = float(ap @ ap)
        if curve == 0 or not np.isfinite(curve):
            break
        alpha = gamma / curve
        x += alpha * p
        s -= alpha * a.transpose_times(ap)
        new = float(s @ s)
        p = s + (new / gamma) * p
        gamma = new
        done += 1
    return x, done, float(np.sqrt(gamma))


_OUT = "matrix_id string, idx int, value double, iterations int, residual double, converged boolean"


def solve_batch(a: DataFrame, b: DataFrame, dims: DataFrame, *, method: str = "least_squares", most: int = 10_000, tol: float = 1e-10, guess: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(matrix_id, idx, value, iterations, residual, converged): each matrix is solved whole by one task.

    Matrices, right-hand sides and guesses meet by matrix_id in one shuffle; many models are the
    parallelism.  For one matrix beyond a task's memory see ``solve_distributed``.
    """
    parts = [a.select("matrix_id", F.lit(0).alias("kind"), "row", "col", "value"), b.select("matrix_id", F.lit(1).alias("kind"), F.col("idx").alias("row"), F.lit(0).alias("col"), "value"), dims.select("matrix_id", F.lit(3).alias("kind"), F.col("n_rows").cast("int").alias("row"), F.col("n_cols").cast("int").alias("col"), F.lit(0.0).alias("value"))]
    if guess is not None:
        parts.append(guess.select("matrix_id", F.lit(2).alias("kind"), F.col("idx").alias("row"), F.lit(0).alias("col"), "value"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.select(F.col("matrix_id").cast("string").alias("matrix_id"), "kind", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))

    def solve(key: str | None, columns: list[np.ndarray]) -> tuple[np.ndarray, int, float]:
        kind, row, col, value = columns
        size = np.flatnonzero(kind == 3)
        if len(size) != 1:
            raise ValueError(f"matrix {key} needs its dimensions once")
        n_rows, n_cols = int(row[size[0]]), int(col[size[0]])
        cells = kind == 0
        coo = Coo(row[cells], col[cells], value[cells], n_rows, n_cols)

        def vector(which: int, n: int) -> np.ndarray | None:
            own = kind == which
            if which == 2 and not own.any():
                return None
            if own.any() and row[own].max() >= n:
                raise ValueError(f"vector of matrix {key} is longer than {n}")
            return np.bincount(row[own], value[own], n)

        rhs, start = vector(1, n_rows), vector(2, n_cols)
        if method == "cg":
            return conjugate_gradient(coo, rhs, most=most, tol=tol, guess=start, strict=strict)
        if method == "pcg":
            return conjugate_gradient(coo, rhs, most=most, tol=tol, guess=start, jacobi=True)
        if method == "least_squares":
            return least_squares(coo, rhs, most=most, tol=tol, guess=start)
        raise ValueError(f"unknown method {method}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("matrix_id", pa.string()), ("idx", pa.int32()), ("value", pa.float64()), ("iterations", pa.int32()), ("residual", pa.float64()), ("converged", pa.bool_())])
        out: list[tuple] = []
        waiting = 0

        def flushed() -> pa.RecordBatch:
            many = np.array([len(x) for _, x, _, _ in out])
            keys = pa.array([k for k, *_ in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), many)))
            left = np.repeat([r for *_, r in out], many)
            return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in many])), pa.array(np.concatenate([x for _, x, _, _ in out])), pa.array(np.repeat([d for _, _, d, _ in out], many).astype(np.int32)), pa.array(left.astype(float)), pa.array(left < tol)], schema=schema)

        for key, columns in groups(batches, lambda c: c.to_numpy(zero_copy_only=False)):
            x, done, left = solve(key, columns)
            out.append((key, x, done, left))
            waiting += len(x)
            if waiting >= 10_000:
                yield flushed()
                out, waiting = [], 0
        if out:
            yield flushed()

    return dealt(rows, "matrix_id", "kind", "row", "col").mapInArrow(run, _OUT)


def solve_distributed(a: DataFrame, b: DataFrame, dims: DataFrame, *, most: int = 100, tol: float = 1e-8) -> DataFrame:
    """Least squares over tables, for matrices too large for one task: (matrix_id, idx, value).

    Each step is two sparse products and two sums; the state is checkpointed to the shared folder each
    step.  Only sums (one row a matrix) reach the driver.
    """
    spark = a.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    a = a.select("matrix_id", "row", "col", "value")
    s = m.transpose_multiply(a, b, dims)
    state = s.select("matrix_id", "idx", F.lit(0.0).alias("x"), F.col("value").alias("s"), F.col("value").alias("p")).checkpoint()
    gamma = state.groupBy("matrix_id").agg(F.sum(F.col("s") * F.col("s")).alias("g"))
    for _ in range(most):
        if float(gamma.agg(F.max("g")).first()[0] or 0.0) < tol * tol:
            break
        p = state.select("matrix_id", "idx", F.col("p").alias("value"))
        ap = m.multiply(a, p, dims)
        curve = m.dot(ap, ap).withColumnRenamed("dot", "c")
        q = m.transpose_multiply(a, ap, dims).select("matrix_id", "idx", F.col("value").alias("q"))
        step = gamma.join(curve, "matrix_id").select("matrix_id", F.when((F.col("c") > 0) & (F.col("g") >= tol * tol), F.col("g") / F.when(F.col("c") > 0, F.col("c"))).otherwise(0.0).alias("alpha"), "g")
        moved = state.join(q, ["matrix_id", "idx"]).join(step, "matrix_id").select("matrix_id", "idx", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), (F.col("s") - F.col("alpha") * F.col("q")).alias("s"), "p", "g").checkpoint()
        new = moved.groupBy("matrix_id").agg(F.sum(F.col("s") * F.col("s")).alias("g"), F.max("g").alias("old"))
        ratio = new.select("matrix_id", F.when(F.col("old") > 0, F.col("g") / F.when(F.col("old") > 0, F.col("old"))).otherwise(0.0).alias("beta"))
        state = moved.join(ratio, "matrix_id").select("matrix_id", "idx", "x", "s", (F.col("s") + F.col("beta") * F.col("p")).alias("p")).checkpoint()
        gamma = new.select("matrix_id", "g")
    return state.select("matrix_id", "idx", F.col("x").alias("value"))
