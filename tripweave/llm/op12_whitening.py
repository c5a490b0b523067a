"""Whitening of embeddings by the leading components of their covariance.

Entries become integers, and each distinct vector counts once, so counts and sums are exact. Tasks add up centred products,
which come to the driver as one matrix of d x d numbers. There the matrix is made tridiagonal by Householder reflections,
Sturm counts bisect for the leading eigenvalues, inverse iteration gives their vectors (made orthogonal again within
clusters of close eigenvalues), and the few components are sent to the tasks, which project every row.

Cases: rows without an id, or whose vector is null, empty or holds null or non-finite entries, take no part, nor do vectors of
another length than the commonest one (the longer of equally common ones), nor entries beyond 2**52 in size, which have no exact
integer. Repeated rows are whitened each, but fitted once. Components without variance (an eigenvalue of at most 1e-12 of
the trace) can't be scaled to one and are left out, so a table of equal vectors gives no rows, as an empty one does. A
deviation that doesn't fit a long is null. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import discard, keep

SCALE = 64
MOST = 16
LARGEST = float(1 << 52)
NO_VARIANCE = 1e-12
_ROWS = 4096                      # rows whose products are added at once


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``x``: floor(scale * entry) of every usable vector as little-endian 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("entries")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.floor(scale * flat)
            ok = np.abs(x) <= LARGEST                         # not for NaN
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~ok)])
            good = bad[ends] == bad[ends - size]
            raw = np.where(ok, x, 0).astype("<i8").tobytes()
            rows = [raw[8 * (b - n):8 * b] for b, n in zip(ends[good].tolist(), size[good].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(rows, pa.binary())],
                                             ["vec_id", "x"])

    entries = F.col("embedding").cast("array<double>")
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
                           & ~F.exists("embedding", lambda c: c.isNull()))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("entries")) \
        .mapInArrow(run, "vec_id long, x binary")


def _commonest_length(x: DataFrame) -> int | None:
    by_length = x.groupBy(F.octet_length("x").alias("bytes")).count()
    top = by_length.orderBy(F.desc("count"), F.desc("bytes")).limit(1).collect()
    return top[0]["bytes"] // 8 if top else None


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as rows of integers."""
    column = batch.column("x").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view("<i8").reshape(-1, d) if len(column) else np.zeros((0, d), np.int64)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension, exactly: halves of 32 bits are added apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(np.append(0, high)),
                                          pa.array(np.append(n, low))], ["dim", "high", "low"])

    made = fit.select("x").mapInArrow(run, "dim int, high long, low long").groupBy("dim") \
        .agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    total = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in made.collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


@dataclass
class Centre:
    """n * x - S in exact integers where they fit, and x - S / n from it."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.fits = all(abs(s) < 1 << 61 for s in self.sums)
        self.small = np.array(self.sums, np.int64) if self.fits else None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; Python's integers where 64 bits are too few."""
        if self.fits and (not x.size or int(np.abs(x).max()) * self.n < 1 << 61):
            return x * self.n - self.small
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, scaled: np.ndarray) -> list[int | None]:
        """The sum of squares of each row."""
        d = scaled.shape[1]
        if scaled.dtype != object and (not scaled.size or d * int(np.abs(scaled).max()) ** 2 < 1 << 63):
            return np.einsum("ij,ij->i", scaled, scaled).tolist()
        exact = [sum(v * v for v in row) for row in scaled.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        return scaled.astype(np.float64) / self.n


def _products(fit: DataFrame, d: int, project, k: int) -> np.ndarray:
    """The sum over all vectors of v v' for v = project(x), which has k numbers."""
    rows, cols = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch, d)
            for i in range(0, len(x), _ROWS):
                v = project(x[i:i + _ROWS])
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], ["i", "j", "v"])

    made = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((k, k))
    out[made["i"], made["j"]] = made["v"]
    return out + np.triu(out, 1).T


# ---- eigenvectors -------------------------------------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q with a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        scale = np.abs(v[1:]).max()
        if scale == 0:
            continue
        v /= max(scale, abs(v[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        row = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        a[k + 1:, k], a[k, k + 1:] = row, row
        a[k + 2:, k], a[k, k + 2:] = 0, 0
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each point."""
    squares = off * off
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, c in enumerate(diagonal):
        pivot = c - at - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, largest first: each is bisected until its interval has no number inside."""
    n = len(diagonal)
    around = np.append(np.abs(off), 0.0) + np.append(0.0, np.abs(off))
    low, high = (diagonal - around).min(), (diagonal + around).max()
    room = 2 * np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny) * n
    lo, hi = np.full(k, low - room), np.full(k, high + room)
    rank = n - 1 - np.arange(k)                                  # this many eigenvalues are smaller
    while True:
        mid = lo + (hi - lo) / 2
        if not ((lo < mid) & (mid < hi)).any():
            return mid
        below = sturm_counts(diagonal, off, mid)
        hi, lo = np.where(below > rank, mid, hi), np.where(below > rank, lo, mid)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right by elimination with row exchanges; pivots of zero become ``least``."""
    n = len(diagonal)
    main, first, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    under, x = off.tolist(), right.tolist()
    for i in range(n - 1):
        if abs(under[i]) > abs(main[i]):
            factor = main[i] / under[i]
            main[i], keep_main = under[i], first[i]
            first[i], second[i] = main[i + 1], first[i + 1]
            main[i + 1], first[i + 1] = keep_main - factor * first[i], -factor * second[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if main[i] == 0:
                main[i] = least
            factor = under[i] / main[i]
            main[i + 1] -= factor * first[i]
            x[i + 1] -= factor * x[i]
    if main[-1] == 0:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= first[i] * x[i + 1]
        if i + 2 < n:
            rest -= second[i] * x[i + 2]
        x[i] = rest / (main[i] if abs(main[i]) > least else np.copysign(least, main[i]))
    return np.array(x)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix for each value, as columns.

    Values closer than a thousandth of the matrix' size form a cluster; its vectors are made orthogonal to each other in
    every round, and shifts that are equal are moved apart by some rounding units.
    """
    n, rng = len(diagonal), np.random.default_rng(7)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = np.finfo(float).eps * size
    vectors, start, shift = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            start = j
        shift = min(value, shift - 4 * least) if j > start else value
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x /= np.linalg.norm(x)
            x = _solve_shifted(diagonal, off, shift, x, least)
            x /= np.abs(x).max()
            for _ in range(2):                                   # twice is enough for full orthogonality
                x -= vectors[:, start:j] @ (vectors[:, start:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit eigenvectors (columns).

    A reducible tridiagonal matrix is no special case: inverse iteration starts from all dimensions.
    """
    size = np.abs(v).max(initial=0.0)
    if not size:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diagonal, off, q = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = q @ inverse_iteration(diagonal, off, values)
    return values * size, vectors


# ---- the operator -------------------------------------------------------------------------------------------------

@dataclass
class Whitening:
    """A fitted whitening; its size is d numbers a component."""

    centre: Centre
    values: np.ndarray
    components: np.ndarray          # one per column
    trace: float
    identity_error: float

    def project(self, scaled: np.ndarray) -> np.ndarray:
        return self.centre.centred(scaled) @ self.components / np.sqrt(self.values)


def fit(x: DataFrame, d: int, most: int = MOST) -> Whitening | None:
    """The leading components over each distinct vector once; None if there are no vectors."""
    distinct = keep(x.where(F.octet_length("x") == 8 * d).select("x").distinct(), "whitening-fit")
    n, sums = _exact_sums(distinct, d)
    if not n:
        discard(distinct)
        return None
    centre = Centre(n, sums)
    v = _products(distinct, d, lambda rows: centre.centred(centre.scaled(rows)), d) / n
    trace = float(np.trace(v))
    values, vectors = leading_components(v, min(most, d))
    some = values > NO_VARIANCE * trace
    model = Whitening(centre, values[some], vectors[:, some], trace, 0.0)
    if some.any():
        k = int(some.sum())                                      # the mean of whitened rows is zero, as S is exact
        spread = _products(distinct, d, lambda rows: model.project(centre.scaled(rows)), k) / n
        model.identity_error = float(np.abs(spread - np.eye(k)).max())
    discard(distinct)
    return model


def whiten(vectors: DataFrame, scale: int = SCALE, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    A constant added to all integers, as some forms of them have, cancels out of every column.
    """
    x = integer_vectors(vectors, scale)
    d = _commonest_length(x)
    model = fit(x, d, most) if d else None
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    k, names = len(model.values), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                scaled = model.centre.scaled(_matrix(part, d))
                m = len(scaled) * k
                deviation = [e for e in model.centre.deviations(scaled) for _ in range(k)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column("vec_id").to_numpy(), k)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(scaled))),
                    pa.array(np.full(m, model.centre.n, np.int64)), pa.array(deviation, pa.int64()),
                    pa.array(model.project(scaled).ravel()),
                    pa.array(np.tile(model.values / model.trace if k else model.values, len(scaled))),
                    pa.array(np.full(m, model.identity_error))], names)

    return x.where(F.octet_length("x") == 8 * d).mapInArrow(run, schema)


def components(vectors: DataFrame, scale: int = SCALE, most: int = MOST) -> Whitening | None:
    """The fitted whitening itself, to be stored or applied elsewhere."""
    x = integer_vectors(vectors, scale)
    d = _commonest_length(x)
    return fit(x, d, most) if d else None
