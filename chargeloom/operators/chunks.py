"""Stations that are too long for one task: their rows in chunks of time, each with what it needs to know of the others.

The rows of a long station are dealt by (station, chunk). A row's number is its place in the chunk and the rows of the
chunks before, the value that fills a gap is the last one of the chunk or else what the chunks before carry over, and
windows are made in blocks of consecutive rows that begin with the last rows of the block before. Prefix sums and
carried values are window functions over one row a chunk. The rows are those of the plain plan in
:mod:`chargeloom.operators.dataset`, on any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, PrepConfig, feature_columns
from ..functions.columns import calendar, occupancy
from ..sources.scratch import materialized
from . import dataset
from .hourly import slot_minutes

#: Stations of more rows are cut into chunks of so many slots.
MAX_ROWS = 500_000
#: Up to so many chunks the table with a row for each is broadcast to the rows; beyond, the join shuffles.
MAX_BROADCAST_CHUNKS = 20_000

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _chunk(rows: int, cfg: PrepConfig) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MINUTE", epoch, F.col(TIME)) / (rows * slot_minutes(cfg.frequency)))


def _known(table: DataFrame) -> DataFrame:
    """A table with a row for each chunk, computed once, to be broadcast if it is small."""
    kept = materialized(table)
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_CHUNKS else kept


def _offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``sizes(*keys, chunk, _size)`` with ``_before``, the rows of the chunks before, and ``n``, those of all."""
    own = Window.partitionBy(*keys)
    before = F.sum("_size").over(own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return sizes.withColumns({"_before": before, "n": F.sum("_size").over(own)})


def numbered_rows(table: DataFrame, cfg: PrepConfig, rows: int) -> DataFrame:
    """``table`` with its ``chunk``, ``row_idx`` and ``split`` (of :func:`dataset.chronological_split`), dealt by station and chunk."""
    dealt = materialized(table.withColumn("chunk", _chunk(rows, cfg)).repartition(STATION, "chunk"))
    offsets = _known(_offsets(dealt.groupBy(STATION, "chunk").agg(F.count(F.lit(1)).alias("_size")), [STATION]).drop("_size"))
    place = F.row_number().over(Window.partitionBy(STATION, "chunk").orderBy(TIME)) - 1
    placed = dealt.withColumn("_place", place).join(offsets, [STATION, "chunk"])
    row_idx = (F.col("_before") + F.col("_place")).cast("long")
    return placed.withColumn("row_idx", row_idx).withColumn("split", dataset.split_of(F.col("row_idx"), F.col("n"), cfg)).drop("_place", "_before", "n")


def impute(numbered: DataFrame, features: list[str]) -> DataFrame:
    """:func:`dataset.impute` of :func:`numbered_rows`: values are filled within a chunk and carried over chunks.

    Of each chunk's part of a split the first and last known values are gathered. A row takes the last value known in its
    part, else the last of the parts before, else the first that the split has.
    """
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("row_idx"))
    parts = numbered.groupBy(STATION, "split", "chunk").agg(*(f(c, known(c)).alias(f"{name}_{c}") for c in features for name, f in (("_first", F.min_by), ("_last", F.max_by))))
    order = Window.partitionBy(STATION, "split").orderBy("chunk")
    carry = {c: F.last(f"_last_{c}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) for c in features}
    head = {c: F.first(f"_first_{c}", ignorenulls=True).over(order.rowsBetween(*_ALL)) for c in features}
    carried = _known(parts.select(STATION, "split", "chunk", *(F.coalesce(carry[c], head[c]).alias(f"_carry_{c}") for c in features)))
    here = Window.partitionBy(STATION, "chunk", "split").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    filled = numbered.withColumns({f"_here_{c}": F.last(c, ignorenulls=True).over(here) for c in features}).join(carried, [STATION, "split", "chunk"])
    return filled.withColumns({c: F.coalesce(f"_here_{c}", f"_carry_{c}") for c in features}).drop(*(f"{p}_{c}" for c in features for p in ("_here", "_carry")))


def clean_splits(hourly: DataFrame, cfg: PrepConfig, rows: int = MAX_ROWS) -> DataFrame:
    """The rows of :func:`dataset.clean_splits` with ``rn`` and ``n``, their place (from 1) in their station's split and its rows, and ``train_rows``."""
    features = feature_columns([*hourly.columns, *occupancy(hourly.columns), *calendar(F.col(TIME))], cfg.target)
    filled = impute(numbered_rows(dataset.add_features(hourly), cfg, rows), features)
    place = F.row_number().over(Window.partitionBy(STATION, "chunk", "split").orderBy(TIME))
    kept = materialized(dataset.complete_rows(filled, features, cfg).withColumn("_place", place))
    sizes = _offsets(kept.groupBy(STATION, "split", "chunk").agg(F.count(F.lit(1)).alias("_size")), [STATION, "split"])
    train = F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("_size"))).over(Window.partitionBy(STATION)), F.lit(0))
    offsets = _known(sizes.withColumn("train_rows", train).drop("_size"))
    placed = kept.join(offsets, [STATION, "split", "chunk"])
    return placed.withColumn("rn", (F.col("_before") + F.col("_place")).cast("long")).drop("_before", "_place", "chunk")


def long_stations(hourly: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """Stations of more than ``rows`` rows: fewer than one for each so many rows of the table."""
    return hourly.groupBy(STATION).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(STATION)


def complete_rows(hourly: DataFrame, cfg: PrepConfig, rows: int = MAX_ROWS) -> DataFrame:
    """:func:`clean_splits` of all stations, kept in the shared folder: long ones in chunks, the others a station in one task each."""
    long = materialized(long_stations(hourly, rows))
    some = long.count()
    if not some:
        return materialized(_placed(dataset.clean_splits(hourly, cfg)))
    known = F.broadcast(long) if some <= MAX_BROADCAST_CHUNKS else long
    short = _placed(dataset.clean_splits(hourly.join(known, STATION, "left_anti"), cfg))
    return materialized(short.unionByName(clean_splits(hourly.join(known, STATION, "left_semi"), cfg, rows)))


def _placed(clean: DataFrame) -> DataFrame:
    train = F.count(F.when(F.col("split") == "train", 1)).over(Window.partitionBy(STATION))
    return dataset.with_position(clean).withColumn("train_rows", train)


def overlapping(placed: DataFrame, cfg: PrepConfig, rows: int = MAX_ROWS) -> DataFrame:
    """Rows with ``rn`` and ``n`` in blocks of ``rows`` of them, each begun by the ``span - 1`` rows before it (but the first).

    What looks back over a window can then work by (station, split, ``block``): the rows without a whole window behind
    them are those that the block before answers for. A split of up to ``rows`` rows is one block.
    """
    if rows < cfg.span:
        raise ValueError(f"blocks of {rows} rows are shorter than a window")
    block = F.floor((F.col("rn") - 1) / rows)
    end = (block + 1) * rows
    again = (F.col("rn") > end - (cfg.span - 1)) & (end < F.col("n"))
    return placed.withColumn("block", F.explode(F.when(again, F.array(block, block + 1)).otherwise(F.array(block))))
