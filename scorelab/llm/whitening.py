"""Embedding whitening by QDWH spectral divide and conquer.

The fit list is every distinct quantised vector once. Spark counts it, sums its
dimensions exactly and forms the centred scatter matrix: each task multiplies
blocks of rows into one d x d matrix, the matrix rows are summed after a shuffle
on their number. What reaches the driver is that matrix, bounded by the
dimension and not by the rows.

The matrix is divided by polar decompositions: the unitary factor U of the shifted
matrix C - s I is its matrix sign, so (U + I) / 2 projects on the subspace of the
eigenvalues above s. Bases of both subspaces give two smaller matrices, which are
divided in turn until single eigenvalues are left, the upper half first and no
further than the components asked for. The polar factor comes from the
dynamically weighted Halley iteration (QDWH): at most a handful of QR or Cholesky
steps, whatever the condition. The mean and the few leading components are then
broadcast and every row is projected where it lies.

Rows whose vector is null, empty or holds null or non-finite entries take no part,
nor do rows whose length differs from the most common one (ties: the longer).
Null vec_ids are ordinary values, repeated rows are returned each time but
fitted once. Components without variance (one distinct vector, or fewer
directions than components) can't be scaled to one and are left out, so a table
without any variance gives no rows, like an empty one. Equal eigenvalues span a
subspace in which any basis is right; one is chosen for all rows. A deviation
that exceeds a long is null in the query; the operator returns it as decimal.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.llm.common import stored
from scorelab.llm.vectors import common_width, finite, matrix

COMPONENTS = 4
SCALE = 256
EPS = np.finfo(float).eps


# --- the small dense part: polar factors and invariant subspaces ---------------


def polar(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, regular matrix by dynamically weighted Halley steps."""
    size = len(a)
    eye = np.eye(size)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))  # and the inverse's the smallest
    except np.linalg.LinAlgError:
        least = EPS
    low = min(max(least, EPS / 4), 1.0)
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            lower = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if moved < np.cbrt(EPS) and 1 - low < 10 * EPS:
            break
    return x @ (1.5 * eye - 0.5 * (x.T @ x))  # a last Newton-Schulz step takes off what rounding left


def _divided(c: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below a shift; None where all eigenvalues are one."""
    size = len(c)
    mean = np.trace(c) / size
    if np.linalg.norm(c - mean * np.eye(size)) <= 4 * EPS * size * scale:
        return None
    best = None
    diagonal = np.diag(c)
    # the mean lies strictly between the extremes; the median halves the work where the diagonal shows the spectrum
    middle = float(np.median(diagonal))
    shifts = [middle, mean] if diagonal.min() < middle < diagonal.max() else [mean]
    for shift in [*shifts, *(mean + np.linalg.norm(c - mean * np.eye(size)) * rng.uniform(-0.5, 0.5, 8))]:
        try:
            sign = polar(c - shift * np.eye(size))
        except np.linalg.LinAlgError:
            continue
        above = round((np.trace(sign) + size) / 2)
        if not 0 < above < size:
            continue
        projector = (sign + np.eye(size)) / 2
        upper = np.linalg.qr(projector @ rng.standard_normal((size, above)))[0]
        lower = np.linalg.qr((np.eye(size) - projector) @ rng.standard_normal((size, size - above)))[0]
        for _ in range(2):  # what the random start left of the other subspace
            upper, lower = np.linalg.qr(projector @ upper)[0], np.linalg.qr(lower - projector @ lower)[0]
        basis = np.linalg.qr(np.hstack([upper, lower]))[0]
        upper, lower = basis[:, :above], basis[:, above:]
        left = np.linalg.norm(lower.T @ c @ upper)
        if best is None or left < best[0]:
            best = (left, upper, lower)
        if left <= 100 * EPS * size * scale:
            break
    if best is None:
        return None
    return best[1], best[2]


def leading(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    c = (c + c.T) / 2
    scale = float(np.linalg.norm(c)) or 1.0
    rng = np.random.default_rng(13)
    vectors: list[np.ndarray] = []
    open_parts = [np.eye(len(c))]  # bases of subspaces, the upper ones last
    while open_parts and len(vectors) < k:
        basis = open_parts.pop()
        own = basis.T @ c @ basis
        halves = _divided((own + own.T) / 2, scale, rng) if basis.shape[1] > 1 else None
        if halves is None:
            vectors += list(basis.T)
        else:
            open_parts += [basis @ halves[1], basis @ halves[0]]
    found = np.linalg.qr(np.array(vectors).T)[0]
    values = np.einsum("ij,ij->j", found, c @ found)
    order = np.argsort(-values, kind="stable")[:k]
    values, found = values[order], _refined(c, found[:, order], values[order])
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return values, found * np.where(signs == 0, 1, signs)


def _refined(c: np.ndarray, found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One Newton step per vector on (c - e) v = 0, |v| = 1 with residuals in extended precision."""
    wide, size = c.astype(np.longdouble), len(c)
    gap_floor = 1e-6 * max(float(np.linalg.norm(c)), EPS)
    out = found.copy()
    for i in range(found.shape[1]):
        others = np.delete(values, i)
        if len(others) and np.abs(others - values[i]).min() < gap_floor:
            continue  # close to a multiple eigenvalue the single vector is no better determined
        v = found[:, i].astype(np.longdouble)
        e = (v @ (wide @ v)) / (v @ v)
        rest = (wide @ v - e * v).astype(float)
        bordered = np.block([[c - float(e) * np.eye(size), -found[:, i : i + 1]], [-found[:, i : i + 1].T, np.zeros((1, 1))]])
        try:
            step = np.linalg.solve(bordered, np.append(-rest, 0.0))[:size]
        except np.linalg.LinAlgError:
            continue
        if np.linalg.norm(step) < 1e-6:
            moved = v + step
            out[:, i] = (moved / np.sqrt(moved @ moved)).astype(float)
    return out


# --- sums over the rows --------------------------------------------------------


def quantised(column: str = "embedding") -> Column:
    """Each component c as floor(256 c), c as double; adding 0 leaves no negative zero."""
    return F.transform(column, lambda c: (F.floor(SCALE * c.cast("double")) + F.lit(0)).cast("long"))


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    whole = rows.where(finite(column)).select("vec_id", quantised(column).alias("x"))
    return whole.where(F.size("x") == common_width(whole, "x"))


def _matrix_rows(batches: Iterator[pa.RecordBatch], size: int, total) -> Iterator[pa.RecordBatch]:
    """One task's d x d sum (or more rows), one row of numbers for each row of the matrix."""
    summed = None
    for batch in batches:
        if batch.num_rows:
            part = total(matrix(batch, "x"))
            summed = part if summed is None else summed + part
    if summed is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(summed)), pa.int32()), pa.array([r.tobytes() for r in summed], pa.binary())], ["i", "part"])


def _added(fit: DataFrame, total, size: int) -> np.ndarray:
    """Sum of ``total(block of x)``, a float matrix with ``size`` columns, over the whole fit list."""
    parts = fit.select("x").mapInArrow(lambda batches: _matrix_rows(batches, size, total), "i int, part binary")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), batch.column("part").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(part)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["i", "part"])

    rows = parts.repartition("i").mapInArrow(gathered, "i int, part binary").collect()
    return np.array([np.frombuffer(r["part"]) for r in sorted(rows, key=lambda r: r["i"])])


def _sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sums per dimension; a task adds in int64 where that is safe, else in whole numbers of any size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            x = matrix(batch, "x")
            safe = not len(x) or int(np.abs(x.astype(float)).max()) * len(x) < 1 << 62
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.select("x").mapInArrow(added, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: size and sums of the fit list, mean, eigenvalues and eigenvectors (columns), trace, error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None above 38 digits."""
        most = int(np.abs(x.astype(float)).max(initial=0)) * self.n + max(map(abs, self.sums))
        safe = most * most * len(self.sums) < 1 << 62
        kind = np.int64 if safe else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(s) if s < 10**38 else None for s in (off * off).sum(axis=1).tolist()]


def fitted(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (vec_id, x); None where the table has no variance."""
    fit = stored(rows.select("x").distinct(), "fit-list")
    head = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, size = head["n"], head["d"]
    if n < 2:
        return None
    sums = _sums(fit, size)
    mean = np.array([s / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        off = x - mean
        return np.vstack([off.T @ off, off.sum(axis=0)])

    scatter = _added(fit, centred, size)
    left = scatter[size] / n  # what rounding the mean left
    covariance = scatter[:size] / n - np.outer(left, left)
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, min(k, size))
    kept = values > 4 * EPS * size * trace
    if not kept.any():
        return None
    plain = Whitening(n, tuple(sums), values[kept], vectors[:, kept], trace, 0.0)

    def checked(x: np.ndarray) -> np.ndarray:
        w = plain.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    count = len(plain.values)
    found = _added(fit, checked, count)
    off = found[count] / n
    error = float(np.abs(found[:count] / n - np.outer(off, off) - np.eye(count)).max())
    return Whitening(n, plain.sums, plain.values, plain.vectors, trace, error)


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, k: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row per vector and component (from 1, by falling variance) of ``rows`` (vec_id, ``column``)."""
    held = usable(rows, column)
    model = fitted(held, k)
    if model is None:
        return held.sparkSession.createDataFrame([], RESULT)
    shared = held.sparkSession.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        count = len(m.values)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x, rows = matrix(batch, "x"), batch.num_rows
                names = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), count)))
                deviation = pa.array(m.deviations(x), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), count)))
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * count, m.n, np.int64)),
                        deviation,
                        pa.array(m.whitened(x).reshape(-1)),
                        pa.array(np.tile(m.values / m.trace, rows)),
                        pa.array(np.full(rows * count, m.error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.mapInArrow(projected, RESULT)
