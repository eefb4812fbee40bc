"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X (n rows of d whole numbers, their means taken off) stay in files of the shared folder. A step is one pass over
them: each task multiplies its rows with the step's vector (Xv), takes off what earlier left vectors already hold, and
multiplies the outcome with its rows again (Xᵀu); sums of d + k + 2 numbers meet by place. The driver keeps right vectors v
and small matrices only: a left vector is X times some d numbers, so a worker forms its own rows' entries of all left
vectors from a d by k matrix, and no column of n numbers is ever stored or moved. Both sides are orthogonalised against
all earlier vectors twice, so the bidiagonal matrix B with X V = U B is exact to rounding, and its small singular value
decomposition gives the components (V times its right vectors) and their deviations (singular values over sqrt(n)).

Steps go on until the wanted components have residuals of rounding size and what the rows hold outside of V is too little
to hide a component as large as the last wanted one, or until V spans all dimensions. Where a step ends in an invariant
subspace (as with eigenvalues that repeat), a new direction that is orthogonal to V goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_files import new_folder, stored

#: Entries c become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this have no exact whole number.
LARGEST = float(1 << 52)
#: Deviations of components below this part of the largest one's count as none.
RANK = 1e-10
#: Rows that are multiplied together in a task.
ROWS = 8192
_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """mean_floor, rest: the means are mean_floor + rest / n, in whole numbers; components (d by k) and deviations by falling
    size; trace: of the covariance."""

    n: int
    mean_floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean_floor).astype(float) - self.rest / self.n


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x (array of bigint) of the rows that take part: vectors that are null, empty or hold a null or an entry that
    isn't finite do not."""
    c = F.col("vector")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: F.coalesce((F.abs(e * F.lit(float(SCALE))) <= LARGEST) & ~F.isnan(e), F.lit(False)))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(good)
    return rows.select("id", F.transform(c, lambda e: F.floor(e * F.lit(float(SCALE))) + F.lit(OFFSET)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and rows of batches, in bounded runs."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, d: int, length: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x) (so many numbers) over all runs of rows; by place, so it combines before it is shuffled."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for _, x in _matrices(batches, d):
            total += part(x)
        at = np.arange(length, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["at", "value"])

    found = rows.select("id", "x").mapInArrow(added, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(length)
    for r in found:
        out[r["at"]] = r["value"]
    return out


def fit_whitening(rows: DataFrame, d: int, most: int = 32) -> Whitening | None:
    """The leading components of rows(id, x) of d numbers each, at most so many; none of a table without rows."""
    exact = F.sum(F.col("c").cast("decimal(20,0)"))
    sums = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(exact.alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not sums:
        return None
    n, totals = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    floors = np.array([s // n for s in totals], np.int64)
    out = Whitening(n, floors, np.array([s - n * (s // n) for s in totals], float), np.zeros((d, 0)), np.zeros(0), 0.0)
    out.components, out.deviations, out.trace = _bidiagonalised(rows, out, d, most)
    return out


def _orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def _bidiagonalised(rows: DataFrame, means: Whitening, d: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    context, draw = rows.sparkSession.sparkContext, np.random.default_rng(17)
    v_all, p_all, t_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; U = X p_all; t_all = Xᵀ U
    b = np.zeros((d + 1, d + 1))
    v, energy = draw.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    while True:
        k = v_all.shape[1]
        held = t_all.T @ v  # Uᵀ X v, of which only the last isn't rounding
        p = v - p_all @ held
        shared = context.broadcast((means, p_all, p))

        def part(x: np.ndarray, shared=shared, k=k) -> np.ndarray:
            means, p_all, p = shared.value
            x = means.centred(x)
            u = x @ p
            return np.concatenate([x.T @ u, (x @ p_all).T @ u if k else [], [u @ u, (x * x).sum()]])

        found = _sums(rows, d, d + k + 2, part)
        shared.destroy()
        xu, again, square, energy = found[:d], found[d : d + k], found[d + k], found[d + k + 1]
        xu, p, square = xu - t_all @ again, p - p_all @ again, square - again @ again  # orthogonalised once more
        size = np.sqrt(energy)
        alpha = np.sqrt(max(square, 0.0))
        v_all = np.column_stack([v_all, v])
        if alpha > size * _EPS * 8:
            u_p, u_t = p / alpha, xu / alpha
        else:
            alpha, u_p, u_t = 0.0, np.zeros(d), np.zeros(d)  # v lies where the rows have nothing
        p_all, t_all = np.column_stack([p_all, u_p]), np.column_stack([t_all, u_t])
        b[k, k] = alpha
        if k:
            b[k - 1, k] = held[-1] + (again[-1] if len(again) else 0.0)
        k += 1
        new = _orthogonal(u_t - alpha * v, v_all)
        beta = np.linalg.norm(new)
        left, values, right = np.linalg.svd(b[:k, :k])
        wanted = min(most, k)
        outside = max(0.0, energy - (b[:k, :k] ** 2).sum() - beta * beta) + beta * beta
        settled = (beta * np.abs(left[-1, :wanted]) <= _EPS * 4 * max(values[0], _EPS)).all()
        if k == d or energy == 0 or settled and wanted == most and outside < 0.99 * values[most - 1] ** 2:
            break
        if beta > size * _EPS * 8:
            v = new / beta
        else:
            v = _orthogonal(draw.standard_normal(d), v_all)
            v = _orthogonal(v / np.linalg.norm(v), v_all)
            v /= np.linalg.norm(v)
    kept = np.flatnonzero(values[:most] > RANK * values[0]) if values[0] > 0 else np.zeros(0, int)
    components = v_all @ right[kept].T
    components /= np.linalg.norm(components, axis=0)
    sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(kept))]) if len(kept) else np.zeros(0)
    return components * sign, values[kept] / np.sqrt(means.n), energy / means.n


def whitened(df: DataFrame, most: int = 32, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of each row that takes part and each of at
    most so many leading components: x = floor(64 * c) + 1000000 of an entry c; deviation: the exact sum over dimensions of
    (n * x - sum of x) squared, null where a bigint can't hold it; whitened: the centred row on the component over its
    deviation; explained: the component's part of the trace; identity_error: the largest entry of the whitened rows'
    covariance less the identity, measured over all rows.

    Left out are rows whose vector is null, empty, or holds a null or an entry that isn't finite or beyond 2^46, and rows of
    another length than most rows have (of lengths as frequent, than the smallest). Components without deviation have no
    whitened rows, so rows that are all equal, or one row alone, give none, like an empty table. Null ids stay, and each of
    repeated rows counts. A component's largest entry is positive. Other columns don't matter."""
    spark = df.sparkSession
    folder = new_folder(spark, "whitening")
    rows = stored(whole_rows(df, id_col, vector), folder, "rows")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    model = fit_whitening(rows, d, most)
    k = len(model.deviations)
    shared = spark.sparkContext.broadcast(model)

    def gram(x: np.ndarray) -> np.ndarray:
        w = shared.value.centred(x) @ (shared.value.components / shared.value.deviations)
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found = _sums(rows, d, k * k + k, gram) / model.n
    mean = found[k * k :]
    covariance = found[: k * k].reshape(k, k) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    explained = model.deviations**2 / model.trace if k else model.deviations

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n, scaled = model.n, model.components / model.deviations
        for ids, x in _matrices(batches, d):
            fits = ((n * (x - model.mean_floor).astype(float) - model.rest) ** 2).sum(1) < 9.2e18
            whole = (n * np.where(fits[:, None], x - model.mean_floor, 0) - model.rest.astype(np.int64)) ** 2
            m = len(x)
            out = [
                ids.take(pa.array(np.repeat(np.arange(m), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, np.int64),
                pa.array(np.repeat(whole.sum(1), k), mask=np.repeat(~fits, k)), (model.centred(x) @ scaled).ravel(), np.tile(explained, m), np.full(m * k, error),
            ]
            names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return rows.select("id", "x").mapInArrow(score, schema)
