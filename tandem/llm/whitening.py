"""Whitening of embeddings by spectrum slicing.

By Sylvester's law of inertia the pivots of an LDLᵀ factorisation of V - sI
have as many positive signs as V has eigenvalues above s. Bisection by such
counts isolates each leading eigenvalue of the covariance V; Rayleigh quotient
iteration from the isolating interval then converges cubically to the pair,
and counts on both sides of the result certify its number.

Only sums over the rows are gathered: the d sums of the entries, the d x d
centred products and the products of the whitened entries. V has the size of
one vector squared, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BOUND = 2.0 ** 52  # larger entries are no exact integers any more
LONGEST = (1 << 63) - 1


# ---- spectrum ---------------------------------------------------------------
def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues greater than ``shift``: positive pivots of the LDLᵀ
    factorisation with Bunch and Parlett's pivots of one row or two."""
    a = matrix - shift * np.eye(len(matrix))
    alpha = (1 + math.sqrt(17)) / 8
    count = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        off = size.copy()
        np.fill_diagonal(off, 0)
        p, q = divmod(int(off.argmax()), len(a))
        if not diagonal[r] and not off[p, q]:
            break  # nothing left but zeros: eigenvalues equal to the shift
        chosen = [r] if diagonal[r] >= alpha * off[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(len(a)), chosen)
        pivot, side = a[np.ix_(chosen, chosen)], a[np.ix_(rest, chosen)]
        count += 1 if len(chosen) == 2 else int(pivot[0, 0] > 0)  # a pivot of two rows has a negative determinant
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return count


def rayleigh(matrix: np.ndarray, shift: float, start: np.ndarray, found: np.ndarray) -> tuple[float, np.ndarray]:
    """The eigenpair that Rayleigh quotient iteration reaches from a shift, kept
    orthogonal to the columns found before."""
    v, size = start, np.abs(matrix).sum(1).max()
    value, best = shift, np.inf
    for turn in range(60):
        shifted = matrix - value * np.eye(len(matrix))
        try:
            w = np.linalg.solve(shifted, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            w = np.linalg.solve(shifted + np.eye(len(matrix)) * size * 1e-15, v)
        for _ in range(2):
            w = w - found @ (found.T @ w)
        w /= np.linalg.norm(w)
        if turn > 1:
            value = float(w @ matrix @ w)
        residual = float(np.linalg.norm(matrix @ w - value * w))
        v = w
        if turn > 2 and residual >= best / 2:
            break
        best = min(best, residual) if turn > 1 else best
    return float(v @ matrix @ v), v


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and unit eigenvectors as columns, up to
    the numerical rank."""
    d = len(matrix)
    reach = float(np.abs(matrix).sum(1).max()) if d else 0.0
    exact = reach * d * np.finfo(float).eps
    if not exact:
        return np.empty(0), np.empty((d, 0))
    counts = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    rng = np.random.default_rng(0)
    values: list[float] = []
    vectors = np.empty((d, 0))
    for number in range(1, min(most, count(exact)) + 1):
        low, high = exact, reach * (1 + 1e-12) + exact  # count(low) >= number > count(high)
        for shift, n in counts.items():
            low, high = (max(low, shift), high) if n >= number else (low, min(high, shift))
        isolated = 0
        while high - low > exact:
            # Alone in the interval, and that has become narrow against what lies around it.
            isolated += count(low) == number and count(high) == number - 1
            if isolated > 6:
                value, v = rayleigh(matrix, (low + high) / 2, rng.normal(size=d), vectors)
                if low - exact <= value <= high + exact and count(value - 4 * exact) >= number > count(value + 4 * exact):
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        else:  # several eigenvalues that doubles can't tell apart
            value, v = rayleigh(matrix, (low + high) / 2, rng.normal(size=d), vectors)
        values.append(value)
        vectors = np.column_stack([vectors, v])
    return np.array(values), vectors


# ---- sums over the rows -------------------------------------------------------
def usable(vector: Column) -> Column:
    """Vectors that take part: neither null nor empty, all entries finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < BOUND))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def integers(vectors: pa.Array) -> np.ndarray:
    """A row of x per vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part is taken off as an integer."""
    whole, part = zip(*(divmod(s, n) for s in sums))
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array(part, np.float64) / n


def entry_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every entry: one row per entry comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = integers(column(batch, "vector"))
                n, sums = n + len(x), x.sum(0) if sums is None else sums + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array([n] * len(sums), pa.int64()), pa.array(sums)],
                                             ["at", "n", "s"])

    whole = "decimal(38,0)"
    found = rows.mapInArrow(run, "at int, n long, s long").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(whole)).alias("s")).orderBy("at").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def product_sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum over the batches of the matrices ``of`` makes of their vectors: a row
    of the matrix at a time is shuffled and added up, and ``size`` rows come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                total += of(column(batch, "vector"))
        yield table(np.arange(size), total)

    def table(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), cells], ["at", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = column(batch, "cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for i, v in zip(column(batch, "at").to_pylist(), values):
                total[i] = total[i] + v if i in total else v
        if total:
            yield table(np.array(list(total)), np.array(list(total.values())))

    kind = "at int, cells array<double>"
    found = rows.mapInArrow(run, kind).repartition("at").mapInArrow(add, kind).collect()
    out = np.zeros((size, size))
    for r in found:
        out[r["at"]] = r["cells"]
    return out


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and leading component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null or empty, holds a null or non-finite entry or one
    of 2^52 or more, or has not the commonest length (ties: the longer one) take
    no part; there are as many components as V has positive eigenvalues, so none
    for a single row or equal rows. Null and repeated ids are returned as they
    come, other columns are left out, and a deviation beyond a long is null. An
    empty table gives no rows.
    """
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col(vector_col)))
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = length["d"]
    rows = rows.where(F.size("vector") == d)
    n, sums = entry_sums(rows)

    def products(vectors: pa.Array) -> np.ndarray:
        x = centred(integers(vectors), n, sums)
        return x.T @ x

    covariance = product_sums(rows, products, d) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    k = len(values)
    explained = values / np.trace(covariance) if k else values

    def projected(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) @ vectors / np.sqrt(values)

    def moments(batch: pa.Array) -> np.ndarray:
        """Products of the whitened entries and, in the last row, their sums."""
        w = projected(integers(batch))
        out = np.zeros((k + 1, k + 1))
        out[:k, :k], out[k, :k] = w.T @ w, w.sum(0)
        return out

    error = 0.0
    if k:
        # The entries are deviations already: their mean is rounding, whose square is taken off.
        found = product_sums(rows, moments, k + 1) / n
        error = float(np.abs(found[:k, :k] - np.outer(found[k, :k], found[k, :k]) - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * (int(np.abs(x).max()) + 1) + max(map(abs, sums))
        if d * largest ** 2 <= LONGEST:
            y = n * x - np.array(sums, np.int64)
            return (y * y).sum(1).tolist()
        totals = (sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist())
        return [t if t <= LONGEST else None for t in totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = integers(column(batch, "vector"))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), n, np.int64)), pa.array(deviations(x), pa.int64()).take(each), pa.array(projected(x).ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
