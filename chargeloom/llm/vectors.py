"""What the operators on embedding vectors share: usable rows, whole numbers, exact sums, results merged over a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as this, so that differences of two fit a 64-bit integer.
LIMIT = 1 << 61
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and without components that are null or not finite."""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, values)`` of the vectors of each length in a column of lists; values is one row a vector."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        own = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
        yield length, rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length)


def whole(values: np.ndarray, factor: int, offset: int = 0) -> np.ndarray:
    """floor(factor * x) + offset as 64-bit integers, between -LIMIT and LIMIT."""
    with np.errstate(over="ignore"):
        scaled = np.floor(factor * values.astype(np.float64))
    return np.clip(np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64) + offset, -LIMIT, LIMIT)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of 64-bit integers as Python integers, which no number of rows overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def tree_merge(parts: DataFrame, add: Callable):
    """The pickled partial results in the one column of ``parts`` added up over a tree of tasks; None without any.

    The driver gets the results of the last level alone: about as many as the root of the number of partitions.
    """

    def merge(a, b):
        return b if a is None else a if b is None else add(a, b)

    return parts.rdd.treeAggregate(None, lambda held, row: merge(held, pickle.loads(row[0])), merge)


def merge_by_length(add: Callable) -> Callable:
    """Dicts from vector length to a partial result, added up length by length."""
    return lambda a, b: a | {k: add(a[k], v) if k in a else v for k, v in b.items()}
