"""Whitening of vectors with components found by FEAST contour integration.

Three passes over the vectors, each a map with small sums per task: their count and sums,
their covariance, and the covariance of the whitened vectors (how far it is from the
identity). What reaches the driver is one matrix of dimensions times dimensions.

The components are eigenvectors of that matrix. Inertia counts (the signs of the pivots of
the shifted matrix in tridiagonal form) say how many eigenvalues exceed a number, which
brackets the wanted ones and cuts them into intervals at gaps. In each interval a
quadrature of complex shifted solves along a circle around it projects a random subspace
onto the eigenvectors inside, a Rayleigh-Ritz step extracts them, and both are repeated
until the residual stops falling; a last such step runs over all intervals together. An interval is done when it has as many converged
eigenvalues as the inertia counts at its two ends differ by, so none can be missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 1024, 100_000
#: Components of this size and beyond make a vector unfit: sums must stay exact.
LARGEST = 2.0 ** 30
#: Cells of a matrix that a task holds at once.
CELLS = 1 << 20
#: Neighbouring eigenvalues whose ratio exceeds 1 by less count as equal.
TIED = 1e-9


@dataclass(frozen=True)
class Feast:
    """components; nodes of the quadrature on a half circle; spare: further columns of
    the subspace; gap: ratio of neighbouring eigenvalues that parts two intervals; rounds:
    of projections before the subspace grows."""

    components: int = 8
    nodes: int = 8
    spare: int = 6
    gap: float = 1.5
    rounds: int = 40
    seed: int = 12


class Inertia:
    """Counts eigenvalues of a symmetric matrix beyond a number, by Sylvester's law."""

    def __init__(self, v: np.ndarray):
        a = np.array(v, dtype=np.float64)
        n = len(a)
        for j in range(n - 2):  # Householder reflections to tridiagonal form
            x = a[j + 1:, j].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            size = x @ x
            if size == 0:
                continue
            p = a[j + 1:, j + 1:] @ x * (2 / size)
            p -= x * (p @ x / size)
            a[j + 1:, j + 1:] -= np.outer(x, p) + np.outer(p, x)
            a[j + 1:, j] -= x * (2 * (x @ a[j + 1:, j]) / size)
        self.main, self.off = np.diag(a).copy(), np.diag(a, -1).copy()
        radius = np.abs(np.append(self.off, 0)) + np.abs(np.append(0, self.off))
        self.low, self.high = float((self.main - radius).min()), float((self.main + radius).max())
        self.scale = max(abs(self.low), abs(self.high))

    def above(self, shift: float) -> int:
        """How many eigenvalues are greater than ``shift``."""
        tiny = max(np.finfo(float).tiny, self.scale * 1e-300)
        pivot, n = 1.0, 0
        for a, b in zip(self.main - shift, np.append(0, self.off)):
            pivot = a - b * b / pivot
            if abs(pivot) < tiny:
                pivot = -tiny
            n += pivot > 0
        return n

    def value(self, rank: int, steps: int = 60) -> float:
        """About the ``rank``-th largest eigenvalue (from 1), by bisection."""
        lo, hi = self.low - 1e-3 * self.scale, self.high + 1e-3 * self.scale
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.above(mid) >= rank else (lo, mid)
        return (lo + hi) / 2


def contour(v: np.ndarray, lo: float, hi: float, y: np.ndarray, nodes: int) -> np.ndarray:
    """``y`` projected onto the eigenvectors of ``v`` with eigenvalues in (lo, hi): Gauss
    quadrature over the upper half of the circle; the lower half is its conjugate."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    radius, eye = (hi - lo) / 2, np.eye(len(v))
    out = np.zeros_like(y)
    for t, w in zip(np.pi / 2 * (at + 1), weight):
        turn = radius * np.exp(1j * t)
        out += (w / 2) * (turn * np.linalg.solve(((lo + hi) / 2 + turn) * eye - v, y)).real
    return out


def feast(v: np.ndarray, lo: float, hi: float, wanted: int, how: Feast) -> np.ndarray:
    """Unit eigenvectors of the ``wanted`` eigenvalues in (lo, hi), by falling eigenvalue."""
    size = min(len(v), wanted + how.spare)
    scale = np.abs(v).sum(1).max()
    while True:
        y = np.random.default_rng([how.seed, wanted, len(v)]).standard_normal((len(v), size))
        stalled, answer, best = 0, None, np.inf
        for _ in range(how.rounds):
            q, _ = np.linalg.qr(contour(v, lo, hi, y, how.nodes))
            value, small = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz in the subspace
            y = q @ small
            inside = np.flatnonzero((value > lo) & (value < hi))[::-1]
            if len(inside) == wanted:
                x = y[:, inside]
                error = np.linalg.norm(v @ x - x * value[inside], axis=0).max() / scale
                if error < best:
                    best, stalled, answer = error, 0, x
                else:
                    stalled += 1
                if best < 1e-15 or stalled > 2 and best < 1e-12:
                    return answer
        if size == len(v):
            raise ArithmeticError(f"no {wanted} eigenvalues converged between {lo} and {hi} (residual {best})")
        size = min(len(v), 2 * size)


def leading(v: np.ndarray, how: Feast = Feast()) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, at most ``components``, and their
    unit eigenvectors as columns (largest entry positive). Eigenvalues that are zero up
    to rounding have no direction and are left out."""
    d = len(v)
    count = Inertia(v)
    floor = d * np.finfo(float).eps * count.scale * 4
    k = min(how.components, count.above(floor)) if count.scale > 0 else 0
    if k == 0:
        return np.zeros(0), np.zeros((d, 0))
    # past the last one wanted, the widest gap that follows is where the lowest interval ends
    for most in (min(count.above(floor), k + how.components), count.above(floor)):
        near = [count.value(i + 1) for i in range(most)] + [count.value(most + 1) if most < d else 0.0]
        near = [max(x, floor) for x in near]
        last = max(range(k, most + 1), key=lambda m: near[m - 1] / near[m])
        if near[last - 1] > (1 + TIED) * near[last]:
            break  # else no number lies between them: look further down
    starts = [0] + [m for m in range(1, last) if near[m - 1] > how.gap * near[m]]
    vectors = []
    for a, b in zip(starts, [*starts[1:], last]):
        # the circle keeps to its own eigenvalues' size, so that those outside are far from it
        lo = max((near[b - 1] + near[b]) / 2, 0.75 * near[b - 1], floor)
        hi = min((near[a - 1] + near[a]) / 2 if a else np.inf, 1.25 * near[a])
        wanted = count.above(lo) - count.above(hi)
        vectors.append(feast(v, lo, hi, wanted, how))
    # one more Rayleigh-Ritz step over all intervals: orthogonal across them to rounding
    q, _ = np.linalg.qr(np.hstack(vectors))
    e, small = np.linalg.eigh(q.T @ v @ q)
    e, x = e[::-1][:k], (q @ small)[:, ::-1][:, :k]
    return e, x * np.sign(x[np.abs(x).argmax(0), np.arange(k)])


def fit_vectors(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, x per length): which rows of a list column are fit, as (length, row) pairs
    in the order of lengths, and per length the fit rows' long entries."""
    flat = col.flatten()
    n = np.where(col.is_valid().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    bad = ~flat.is_valid().to_numpy(zero_copy_only=False)
    c = flat.fill_null(0).to_numpy(zero_copy_only=False)
    bad |= ~(np.abs(c) < LARGEST)
    ends = np.cumsum(n)
    worse = np.append(0, np.cumsum(bad))
    ok = (n > 0) & (worse[ends] == worse[ends - n])
    x = np.floor(SCALE * np.where(bad, 0, c)).astype(np.int64) + SHIFT
    rows, mats = [], []
    for d in np.unique(n[ok]).tolist():
        at = np.flatnonzero(ok & (n == d))
        rows.append(np.column_stack([np.full(len(at), d), at]))
        mats.append(x[(ends[at] - d)[:, None] + np.arange(d)])
    return (np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)), mats


def _of_length(col: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x) of the fit rows of length ``d``."""
    rows, mats = fit_vectors(col)
    for m in mats:
        if m.shape[1] == d:
            return rows[rows[:, 0] == d, 1], m
    return np.zeros(0, np.int64), np.zeros((0, d), np.int64)


def _chunks(b: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, d))
    return (b.slice(i, step) for i in range(0, b.num_rows, step))


def count_and_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S): of the fit vectors of the commonest length (of equally common ones the
    largest), their number and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b, 64):
                for m in fit_vectors(part.column(0))[1]:
                    d = m.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, len(m))), pa.array(m.sum(0))], ["d", "i", "n", "s"])

    parts = vectors.mapInArrow(run, "d bigint, i bigint, n bigint, s bigint")
    sums = written(parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "feast-sums")
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, []
    return top.n, [int(r.s) for r in sums.where(F.col("d") == top.d).orderBy("i").collect()]


def product_sums(vectors: DataFrame, d: int, mean: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the fit vectors less ``mean``, projected on ``by`` if
    given. Every task sends the sums of its rows, which Spark adds up cell by cell."""
    k = d if by is None else by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for part in _chunks(b, d):
                z = _of_length(part.column(0), d)[1] - mean
                if by is not None:
                    z = z @ by
                total += z.T @ z
                first += z.sum(0)
        both = np.vstack([total, first])
        if both.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)),
                                              pa.array(both.ravel())], ["i", "j", "v"])

    out = np.zeros((k + 1, k))
    cells = vectors.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out[k], out[:k]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 per row, exact; null beyond a long."""
    top = 1 << 63
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if len(sums) * reach * reach < top:
        a = n * x - np.array(sums, np.int64)
        return (a * a).sum(1).tolist()
    if reach < top:  # the squares may still fit: decide by their size, then exactly
        a = n * x - np.array(sums, np.int64)
        if len(sums) * int(np.abs(a).max(initial=0)) ** 2 < top:
            return (a * a).sum(1).tolist()
    out = []
    for row in x.tolist():
        s = sum((n * v - t) ** 2 for v, t in zip(row, sums))
        out.append(s if s < top else None)
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", how: Feast = Feast()) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per fit
    vector and component, the components numbered from 1 by falling eigenvalue.

    Fit is a vector without null or non-finite entries (nor any of 2^30 and beyond), of
    the commonest length; others give no rows. Rows with a null or repeated id each count.
    A component without variance (more components than independent vectors) has null
    ``whitened``; a deviation beyond a long is null; an empty table gives no rows. Columns
    other than the two named are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, sums = count_and_sums(rows.select("v"))
    if n == 0:
        return spark.createDataFrame([], schema)
    d = len(sums)
    mean = np.array([s / n for s in sums])
    cov = product_sums(rows.select("v"), d, mean)[1] / n
    e, x = leading(cov, how)
    by = x / np.sqrt(e)
    k = len(e)
    error = 0.0
    if k:
        first, products = product_sums(rows.select("v"), d, mean, by)
        error = float(np.abs(products / n - np.outer(first / n, first / n) - np.eye(k)).max())
    trace = float(np.trace(cov))
    every = min(how.components, d)
    explained = [float(v) / trace for v in e] + [0.0] * (every - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b, d):
                at, m = _of_length(part.column(1), d)
                if len(at):
                    z = [[*r, *[None] * (every - k)] for r in ((m - mean) @ by).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(deviations(m, n, sums), pa.int64()), pa.array(z, pa.list_(pa.float64()))],
                        ["id", "deviation", "z"])

    out = rows.mapInArrow(run, f"id {kind}, deviation bigint, z array<double>")
    return out.select(F.col("id").alias(id_col), "deviation", F.posexplode("z").alias("pos", "whitened")).select(
        id_col, (F.col("pos") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("pos") + 1).alias("explained"), F.lit(error).alias("identity_error"))
