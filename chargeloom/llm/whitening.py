"""Whitened principal components of embedding vectors from an exact mean and a covariance centred before it is multiplied.

The first pass over the vectors adds whole numbers, so the mean is exact. The second adds outer products of vectors
less that mean, a matrix product a batch, and a tree of tasks merges the matrices. LAPACK's symmetric solver gives
the components on the driver, whose only data are a few matrices of the vectors' dimension; they are broadcast to
project every vector. A last pass measures how far the covariance of the whitened vectors is from the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune
from .vectors import LONG, by_length, exact_sums, merge_by_length, tree_merge, usable, whole

FACTOR, OFFSET, COMPONENTS = 1024, 100_000, 8

#: Eigenvalues below this share of the largest, times the dimension, are rounding and not variance.
_ROUNDING = 2.0**-46

COLUMNS = ("n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Fit:
    """The fit of all vectors of one length."""

    n: int
    sums: np.ndarray
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray | None = None
    scales: np.ndarray | None = None
    explained: list[float | None] | None = None
    error: float | None = None

    @classmethod
    def of(cls, n: int, sums: np.ndarray) -> Fit:
        """The mean in two parts: the nearest whole number, and what is left of it, below one."""
        base = [(2 * s + n) // (2 * n) for s in sums.tolist()]
        rest = [float(s - n * b) / n for s, b in zip(sums.tolist(), base)]
        return cls(n, sums, np.array(base, np.int64), np.array(rest, np.float64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers less the mean: the difference to the whole part is exact, so large values cost no precision."""
        return (x - self.base).astype(np.float64) - self.rest

    def solve(self, products: np.ndarray, most: int) -> None:
        """Components by falling eigenvalue of the covariance; the largest entry of each is positive."""
        values, vectors = np.linalg.eigh((products + products.T) / (2 * self.n))
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(vectors.shape[1])
        trace = float(np.trace(products)) / self.n
        varies = values > max(values.max(initial=0), 0) * len(self.base) * _ROUNDING
        self.components = vectors * np.where(signs == 0, 1, signs)
        self.scales = np.where(varies, np.sqrt(np.where(varies, values, 1)), np.nan)
        self.explained = [max(0.0, float(v)) / trace if trace > 0 else None for v in values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of their variance; not-a-number for components without variance."""
        return (self.centred(x) @ self.components) / self.scales

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the dimensions of (n * x - S)^2, exact up to the largest long, which stands for more.

        With u = x - base and r = S - n * base that is n^2 * sum(u^2) - 2n * sum(u * r) + sum(r^2); the sums of
        each row are whole numbers of 64 bits, unless the values are huge.
        """
        u, r = x - self.base, self.sums - self.n * self.base.astype(object)
        most = max(int(np.abs(u).max(initial=0)), 1)
        if most * max(most, self.n) * max(1, u.shape[1]) < LONG:
            squares, mixed = (u * u).sum(axis=1).tolist(), (u @ r.astype(np.int64)).tolist()
        else:
            squares, mixed = ([sum(f) for f in rows] for rows in ([[a * a for a in row] for row in u.tolist()], [[a * b for a, b in zip(row, r)] for row in u.tolist()]))
        own = sum(b * b for b in r.tolist())
        return [min(LONG, self.n * (self.n * s - 2 * m) + own) for s, m in zip(squares, mixed)]


def _partials(vectors: DataFrame, vector_col: str, of: Callable[[int, np.ndarray], object], add: Callable) -> dict:
    """``of(length, whole numbers)`` of every batch, added up by vector length."""
    both = merge_by_length(add)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for length, _, values in by_length(batch.column(0)):
                held = both(held, {length: of(length, whole(values, FACTOR, OFFSET))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["part"])

    return tree_merge(vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(emit, "part binary"), both) or {}


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merge_moments(a, b):
    """Counts, means and centred products of two parts as those of both."""
    (n, mean, m), (k, other, o) = a, b
    step = other - mean
    return n + k, mean + step * (k / (n + k)), m + o + np.outer(step, step) * (n * k / (n + k))


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """Fits of usable ``vectors`` by vector length, from three passes over them."""
    counted = _partials(vectors, vector_col, lambda _, x: (len(x), exact_sums(x)), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    fits = {length: Fit.of(n, sums) for length, (n, sums) in counted.items()}
    known = vectors.sparkSession.sparkContext.broadcast(fits)

    def products(length: int, x: np.ndarray) -> np.ndarray:
        c = known.value[length].centred(x)
        return c.T @ c

    for length, total in _partials(vectors, vector_col, products, lambda a, b: a + b).items():
        fits[length].solve(total, components)
    known.unpersist()
    solved = vectors.sparkSession.sparkContext.broadcast(fits)
    for length, (n, _, total) in _partials(vectors, vector_col, lambda d, x: _moments(solved.value[d].whitened(x)), _merge_moments).items():
        here = ~np.isnan(fits[length].scales)
        found = np.abs(total[np.ix_(here, here)] / n - np.eye(int(here.sum())))
        fits[length].error = float(found.max()) if found.size else None
    solved.unpersist()
    return fits


def whiten(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows whose vector can be used, with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    A component c of a vector counts as the whole number x = floor(1024 * c) + 100000. ``n`` is the number of vectors,
    ``deviation`` the sum of (n * x - sum)^2 over the dimensions, ``whitened`` the vector on the first ``components``
    principal components, each with variance one, ``explained`` their shares of all variance, and
    ``identity_error`` the largest entry of the covariance of all whitened vectors less the identity.

    Defined cases: rows whose vector is null, or holds a null or a number that is not finite, go. Vectors of each
    length are fitted by themselves; an empty vector has empty arrays. A vector has no more components than
    dimensions. A component without variance (equal vectors, one vector, dependent dimensions) has a null
    whitened value, and ``explained`` is null where nothing varies; ``identity_error`` is over the others, and null
    without any. Of equal eigenvalues any basis is one. x beyond 2^61, and a deviation beyond a long, count as
    that bound. Repeated rows count each; the id is not read; an empty table gives no rows. Other columns
    stay, those named like the five new ones are replaced.

    The driver holds two matrices of d x d numbers for vectors of d dimensions, whatever the number of rows.
    """
    tune(vectors.sparkSession)
    rows = vectors.filter(usable(F.col(vector_col)))
    fits = vectors.sparkSession.sparkContext.broadcast(fit(rows, vector_col, components))
    kinds = T.StructType([T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType())])

    @F.arrow_udf(kinds)
    def project(column: pa.Array) -> pa.Array:
        out: list[dict | None] = [None] * len(column)
        for length, at, values in by_length(column):
            own, x = fits.value[length], whole(values, FACTOR, OFFSET)
            white = own.whitened(x)
            white = np.where(np.isnan(white), None, white.astype(object)) if np.isnan(own.scales).any() else white
            for i, d, w in zip(at.tolist(), own.deviations(x), white.tolist()):
                out[i] = {"n": own.n, "deviation": d, "whitened": w, "explained": own.explained, "identity_error": own.error}
        lists = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", lists), ("explained", lists), ("identity_error", pa.float64())]))

    found = project(F.col(vector_col).cast("array<double>"))
    others = [c for c in rows.columns if c.lower() not in COLUMNS]
    return rows.select(*others, found.alias("_found")).select(*others, *(F.col("_found")[c].alias(c) for c in COLUMNS))
