"""Helpers that the corpus operators share: Arrow batches, row keys, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialized, shared_folder

ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by rows and by bytes.

    Documents vary from empty to megabytes, so the default of 10,000 rows a batch does not bound a
    worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tables(sf_dir: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of the named table below ``sf_dir``."""
    return lambda spark, name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the driver and all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unused_name(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has (Spark's names are equal whatever their case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table in ``folder``, read back: cut from its lineage, and read column by column."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


checkpointed = materialized


def fold(id_col: Column) -> Column:
    """crc32 of the id written as text, modulo 4; remainder 2 is the held-out part."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4


def hash_share(*cols: Column | str) -> Column:
    """A number from 0 to 1 that the hash of the columns fixes."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, marks


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; nulls count as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def row_groups(marks: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose texts hold ``most`` bytes together; a longer row stands alone."""
    first, rows = 0, len(marks) - 1
    while first < rows:
        last = int(np.searchsorted(marks, marks[first] + most, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


_holder: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Let one operator at a time keep things in a worker: what another one kept is dropped.

    Workers are used again by later stages, and would otherwise gather the caches of all of them.
    """
    if _holder and _holder[0][0] != owner:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((owner, drop))


class BoundedCache(dict):
    """A dict that forgets everything once it holds ``limit`` entries."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) >= self.limit:
            self.clear()
