"""Whitening of embeddings by their leading principal components (operator 11).

The covariance of the distinct vectors is summed over all partitions after centring. Its
leading eigenpairs come from Householder tridiagonalisation, bisection on Sturm counts and
inverse iteration, with the vectors of close eigenvalues made orthogonal. The components, a
matrix of one vector per component, travel with the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.llm.shared import saved

Parts = Callable[[np.ndarray], np.ndarray]

#: A vector's covariance is held by the driver and its components by every task.
MOST_DIMENSIONS = 4096
#: Eigenvalues closer than this share of the largest one have their vectors made orthogonal.
CLOSE = 1e-3
#: Eigenvalues below this share of the largest one are zero but for rounding.
NO_VARIANCE = 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and
    the reflections' unit vectors, each from its row on."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        scale = np.abs(x).max()
        if scale:
            v = x / scale
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            head = a[k, k + 1 :] - 2 * (a[k, k + 1 :] @ v) * v
            a[k, k + 1 :] = a[k + 1 :, k] = head
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: for each shift how many eigenvalues are smaller."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0)))
    squared = np.concatenate([[0.0], off**2])
    pivot = np.ones(len(shifts))
    count = np.zeros(len(shifts), np.int64)
    for d, s in zip(diagonal, squared):
        pivot = d - shifts - s / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues of a tridiagonal matrix, falling, by bisection."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    width = max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - width * 1e-15 * n, high + width * 1e-15 * n
    place = n - np.arange(count)
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        # The k-th largest is below a shift with at least n - k + 1 smaller ones.
        under = below(diagonal, off, middle) >= place
        high = np.where(under, middle, high)
        low = np.where(under, low, middle)
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a tridiagonal system, by elimination with row exchanges; pivots of
    zero are made tiny."""
    n = len(diagonal)
    d, u = diagonal.tolist(), [*off.tolist(), 0.0]
    low, u2, b = off.tolist(), [0.0] * n, right.tolist()
    size = max(map(abs, [*d, *u]))
    tiny = np.finfo(float).eps * (size or 1.0)
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], low[k], u[k], d[k + 1] = low[k], d[k], d[k + 1], u[k]
            u2[k], u[k + 1] = u[k + 1], 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(d[k]) < tiny:
            d[k] = tiny
        factor = low[k] / d[k]
        d[k + 1] -= factor * u[k]
        u[k + 1] -= factor * u2[k]
        b[k + 1] -= factor * b[k]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    x = [0.0] * (n + 2)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - u[k] * x[k + 1] - u2[k] * x[k + 2]) / d[k]
    return np.array(x[:n])


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, a column for each of the falling ``values``, by inverse iteration."""
    n = len(diagonal)
    out = np.zeros((n, len(values)))
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    random = np.random.default_rng(1)
    first = 0
    shift = None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * norm:
            first = k
        # Equal values get shifts a little apart, so that their systems differ.
        gap = 2 * np.finfo(float).eps * norm
        shift = value if shift is None or first == k else min(value, shift - gap)
        x = random.uniform(-1, 1, n)
        for _ in range(6):
            x = solved(diagonal - shift, off, x / np.abs(x).max())
            for _ in range(2):
                x = x - out[:, first:k] @ (out[:, first:k].T @ x)
            x = x / np.linalg.norm(x)
        out[:, k] = x
    return out


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns."""
    scale = float(np.abs(matrix).max(initial=0))
    if not scale:
        return np.zeros(count), np.eye(len(matrix))[:, :count]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    out = vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return values * scale, out / np.linalg.norm(out, axis=0)


def finite(entries: str) -> Column:
    """True for a list without null, infinite and undefined entries."""
    ok = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(entries).isNotNull() & ok


def lattice(entries: str, scale: float, shift: int) -> Column:
    """Entries as whole numbers."""
    return F.transform(entries, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift))


def rows_of(batch: pa.RecordBatch, column: int, dimensions: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def summed(rows: DataFrame, parts: Parts, dimensions: int, entries: int, kind: str = "double") -> np.ndarray:
    """The sum over all partitions of what ``parts(matrix)`` gives, ``entries`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = parts(rows_of(batch, 0, dimensions))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(entries), pa.int32()), pa.array(total.ravel())], ["place", "part"]
            )

    sums = rows.select("x").mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("s"))
    out = np.zeros(entries, np.int64 if kind == "long" else np.float64)
    for place, value in sums.toLocalIterator():
        out[place] = value
    return out


def whiten(
    embeddings: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
) -> DataFrame:
    """Whitened coordinates of the vectors in ``embedding``.

    Entries become whole numbers ``x = floor(scale * c) + shift``. The fit takes each distinct
    vector x once: their number ``n``, sums ``S`` and covariance V (divisor n). Returns for
    each row ``vec_id``, ``n``, ``deviation`` (the sum of ``(n * x - S) ** 2``, exact),
    ``whitened`` (a list: x - S / n on each component over the root of its eigenvalue),
    ``explained`` (a list: eigenvalues over the trace of V) and ``identity_error`` (how far
    the covariance of the whitened fit vectors is from the identity).

    Rows whose vector is null, empty or has null or non-finite entries are left out; of
    vectors of several lengths only those of the commonest length (of equally common ones the
    longest) take part. Directions without variance are no components, so a table of one
    distinct vector, as one of none, gives empty lists or no rows. Repeated rows and rows of
    one id are answered each for itself; a null ``vec_id`` stays null; other columns are not
    read. Vectors of more than MOST_DIMENSIONS entries raise ValueError, a deviation above 63
    bits OverflowError.
    """
    spark = embeddings.sparkSession
    kept = embeddings.where(finite("embedding") & (F.size("embedding") > 0))
    sizes = kept.groupBy(F.size("embedding").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    schema = (
        "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    )
    if common is None:
        return spark.createDataFrame([], schema)
    dimensions = common["size"]
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; at most {MOST_DIMENSIONS} can be whitened")
    rows = kept.where(F.size("embedding") == dimensions).select(
        "vec_id", lattice("embedding", scale, shift).alias("x")
    )
    fit = saved(rows.select("x").distinct(), "vectors")
    n = fit.count()
    sums = summed(fit, lambda x: x.sum(axis=0), dimensions, dimensions, "long")

    def centred(x: np.ndarray) -> np.ndarray:
        # Exact before the division, for the shift is large beside the spread.
        return (n * x - sums) / float(n)

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    covariance = summed(fit, products, dimensions, dimensions * dimensions).reshape(dimensions, dimensions) / n
    values, axes = leading_pairs((covariance + covariance.T) / 2, min(components, dimensions))
    present = values > NO_VARIANCE * max(values.max(initial=0), 0.0)
    values, axes = values[present], axes[:, present]
    matrix, count = axes / np.sqrt(values), len(values)
    explained = (values / np.trace(covariance)).tolist() if count else []

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.hstack([centred(x) @ matrix, np.ones((len(x), 1))])
        return w.T @ w

    error = 0.0
    if count:
        again = summed(fit, moments, dimensions, (count + 1) ** 2).reshape(count + 1, count + 1) / n
        spread = again[:count, :count] - np.outer(again[count, :count], again[count, :count])
        error = float(np.abs(spread - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, 1, dimensions)
            away = n * x - sums
            if len(x) and float(np.abs(away).max()) ** 2 * dimensions >= 2.0**63:
                exact = [sum(v * v for v in row) for row in away.tolist()]
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation has more than 63 bits")
                deviation = pa.array(exact, pa.int64())
            else:
                deviation = pa.array((away * away).sum(axis=1), pa.int64())
            flat = (away / float(n)) @ matrix
            ends = pa.array(np.arange(len(x) + 1) * count, pa.int32())
            whitened = pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, whitened], ["vec_id", "deviation", "whitened"])

    shown = rows.mapInArrow(project, "vec_id long, deviation long, whitened array<double>")
    return shown.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
