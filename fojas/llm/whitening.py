"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors are taken in whole numbers x, so counts, sums and products are exact. One pass adds up x, the next
the products of x less the rounded mean; what the rounding left is put right in whole numbers, and the
covariance V is rounded once. On the driver, which holds a number or two for each pair of dimensions whatever
the rows, V = L L' by Cholesky with the largest remaining diagonal first, ended where nothing but rounding
remains. One-sided Jacobi turns pairs of L's columns until all stand at right angles: L J = U S, so the columns'
squared lengths are the eigenvalues of V and their directions its components. V is never formed anew
from L, which is what keeps small eigenvalues accurate.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that one numpy step works on.
CHUNK_ENTRIES = 1 << 20
#: Whole numbers up to here are exact as doubles, and so are their sums.
EXACT = 2**53


@dataclasses.dataclass(frozen=True)
class Model:
    """What a fit finds; arrays of components and no more than dimensions times dimensions."""

    n: int
    sums: list[int]
    trace: float
    #: Falling, and the components of the same places as columns.
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def usable(vector: str) -> Column:
    """Whether a vector has entries and all are there, finite and below 2 ** 46 (their x is an exact number)."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**46, F.lit(False))), F.lit(False))


def whole(entries: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.floor(scale * entries).astype(np.int64) + shift


def fit_rows(rows: DataFrame, vector: str = "vec") -> tuple[DataFrame, int]:
    """The rows whose vector is usable and of the most frequent length (of equals the longest), and that length."""
    good = rows.filter(usable(vector))
    found = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = found["d"] if found else 0
    return good.filter(F.size(vector) == d), d


def _blocks(batch: pa.RecordBatch, d: int, scale: float, shift: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, x) of pieces of a batch."""
    vectors = batch.column("vec")
    step = max(1, CHUNK_ENTRIES // max(1, d))
    for at in range(0, len(vectors), step):
        some = vectors.slice(at, step)
        yield at, at + len(some), whole(some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), d), scale, shift)


def _upper(matrix: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    a, b = np.triu_indices(len(matrix))
    values = [Decimal(int(v)) for v in matrix[a, b]] if pa.types.is_decimal(kind) else matrix[a, b]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(values, kind)], names=["a", "b", "v"])


def sums_of(rows: DataFrame, d: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """Rows and exact sums of x by dimension; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for at, to, x in _blocks(batch, d, scale, shift):
                n, total = n + to - at, total + x.astype(object).sum(0) if np.abs(x).max() * float(len(x)) >= 2**62 else total + x.sum(0).astype(object)
        if n:
            values = [Decimal(int(v)) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(values, pa.decimal128(38, 0))], names=["a", "v"])

    found = {r["a"]: int(r["v"]) for r in rows.select("vec").mapInArrow(run, "a int, v decimal(38,0)").groupBy("a").agg(F.sum("v").alias("v")).collect()}
    return found.get(-1, 0), [found.get(a, 0) for a in range(d)]


def covariance(rows: DataFrame, d: int, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """V over the rows, divisor n: exact products of x less its rounded mean, each entry of V rounded once."""
    middle = np.array([round(Decimal(s) / n) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for _, _, x in _blocks(batch, d, scale, shift):
                x = x - middle
                largest = int(np.abs(x).max())
                step = max(1, EXACT // max(1, largest * largest))
                for at in range(0, len(x), step):
                    part = x[at : at + step]
                    if largest * largest < EXACT:
                        part = part.astype(np.float64)
                        total += (part.T @ part).astype(np.int64).astype(object)  # sums below 2 ** 53: exact
                    else:
                        total += part.T.astype(object) @ part.astype(object)
        yield _upper(total, pa.decimal128(38, 0))

    summed = rows.select("vec").mapInArrow(run, "a int, b int, v decimal(38,0)").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    for a, b, v in summed:
        out[a, b] = out[b, a] = (n * int(v) - rest[a] * rest[b]) / (n * n)  # whole numbers divided: rounded once
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with v = L L' in v's own order of rows; the largest diagonal that remains comes next."""
    d = len(v)
    rest, columns, diagonal = v.copy(), [], np.diag(v).copy()
    least = 4 * d * np.finfo(float).eps * (diagonal.max() if d else 0)
    for _ in range(d):
        p = int(np.argmax(diagonal))
        if diagonal[p] <= least:
            break
        column = rest[:, p] / np.sqrt(diagonal[p])
        column[[q for q, c in columns]] = 0
        column[p] = np.sqrt(diagonal[p])
        columns.append((p, column))
        rest -= np.outer(column, column)
        diagonal = np.diag(rest).copy()
        diagonal[[q for q, c in columns]] = 0
    return np.array([c for _, c in columns]).reshape(len(columns), d).T


def jacobi(factor: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, falling, and unit columns) of the factor's columns turned to right angles.

    A sweep meets all pairs, as many at a time as have no column in common.
    """
    a = factor.copy()
    r = a.shape[1]
    seats = list(range(r + r % 2))
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[half:][::-1]) if max(p, q) < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            skew = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not skew.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[skew], q[skew], x[:, skew], y[:, skew], xx[skew], yy[skew], xy[skew]
            z = (yy - xx) / (2 * xy)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], a[:, order] / np.sqrt(values[order])


def fit(rows: DataFrame, d: int, components: int, scale: float = 64.0, shift: int = 1_000_000) -> Model:
    """The first ``components`` components of x = floor(scale * c) + shift over rows (vec) of length ``d``."""
    n, sums = sums_of(rows, d, scale, shift)
    if not n:
        return Model(0, [0] * d, 0.0, np.zeros(0), np.zeros((d, 0)))
    v = covariance(rows, d, n, sums, scale, shift)
    values, vectors = jacobi(pivoted_cholesky(v))
    return Model(n, sums, float(np.trace(v)), values[:components], vectors[:, :components])


def _whitened(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, which is exact, and the whitened rows)."""
    sums = np.array(model.sums, np.int64 if max(map(abs, model.sums), default=0) < 2**62 else object)
    apart = model.n * x.astype(sums.dtype) - sums if model.n * float(np.abs(x).max(initial=0)) < 2**62 else model.n * x.astype(object) - sums
    return apart, (apart.astype(np.float64) / model.n) @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Model, scale: float = 64.0, shift: int = 1_000_000) -> float | None:
    """The largest entry of the whitened rows' covariance (divisor n, centred by each task, then as a whole)
    minus the identity; null where there are no components."""
    r = len(model.values)
    if not r:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(r), np.zeros((r, r))
        for batch in batches:
            for at, to, x in _blocks(batch, model.dimensions, scale, shift):
                w = _whitened(x, model)[1]
                own = w.mean(0)
                w, m = w - own, to - at
                spread += w.T @ w + np.outer(own - mean, own - mean) * (n * m / (n + m))
                mean, n = mean + (own - mean) * (m / (n + m)), n + m
        if n:
            yield _upper(spread + n * np.outer(mean, mean), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(r, -1, np.int32)), pa.array(np.arange(r, dtype=np.int32)), pa.array(n * mean)], names=["a", "b", "v"])

    summed = {(x["a"], x["b"]): x["v"] for x in rows.select("vec").mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()}
    mean = [summed[-1, a] / model.n for a in range(r)]
    return max(abs(summed[a, b] / model.n - mean[a] * mean[b] - (a == b)) for a in range(r) for b in range(a, r))


def whiten(rows: DataFrame, model: Model, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(id, vec) of the model's length to (id, deviation, whitened array<double>).

    ``deviation`` is the exact sum of (n x - S) squared, null where that is beyond 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = len(model.values)
        for batch in batches:
            for at, to, x in _blocks(batch, model.dimensions, scale, shift):
                apart, w = _whitened(x, model)
                if apart.dtype == object or float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= 2**62:
                    apart = apart.astype(object)
                squares = [int(s) if s < 2**63 else None for s in (apart * apart).sum(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * r), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(squares, pa.int64()), lists], names=["id", "deviation", "whitened"])

    return rows.select("id", "vec").mapInArrow(run, "id long, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(id, vec) to (id, component, n, deviation, whitened, explained, identity_error), a row for each usable
    row and component.

    Left out are rows whose vector is null or empty, holds null, non-finite or huge entries (2 ** 46 and
    more), or has another length than most vectors. Equal rows and rows with one id or a null id are rows
    each. Components are numbered from 1 by falling eigenvalue; where the vectors span fewer dimensions than
    ``components``, there are only those with an eigenvalue above rounding, and one vector or an empty
    table gives no rows. Equal eigenvalues leave their components' turn open, as any does; it is the same
    for all rows and in reruns. Other columns are not read.
    """
    rows, d = fit_rows(rows.select(F.col("id").cast("long").alias("id"), "vec"))
    model = fit(rows, d, components, scale, shift)
    error = identity_error(rows, model, scale, shift)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    parts = F.arrays_zip(F.col("whitened"), share.alias("explained"))
    found = whiten(rows, model, scale, shift).select("id", "deviation", F.posexplode(parts).alias("place", "part"))
    return found.select(
        "id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
