"""Hourly rows to features, chronological splits, scaled rows and windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SPLITS, STATION, TIME, PrepConfig, feature_columns
from ..functions.columns import calendar, finite, occupancy
from ..sources.scratch import materialized

#: What windows are made within.
SERIES = (STATION, "split")

_EPSILON = 2.220446049250313e-16
#: Rows of a station whose moments the scaler takes together.
MOMENT_ROWS = 1 << 16


def align_columns(tables: list[DataFrame]) -> DataFrame:
    """Tables under the union of their columns, in order of appearance; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def add_features(hourly: DataFrame) -> DataFrame:
    """Occupancy shares and calendar features; both before anything is imputed."""
    return hourly.withColumns(occupancy(hourly.columns)).withColumns(calendar(F.col(TIME)))


def split_ends(n: Column, cfg: PrepConfig) -> tuple[Column, Column]:
    """Rows up to the end of train and of val for a station of n rows; short stations follow their own rules."""
    train = F.least(F.greatest(F.floor(n.cast("double") * F.lit(cfg.train_ratio)), F.lit(1)), n - 2)
    val = F.least(F.greatest(F.floor(n.cast("double") * F.lit(cfg.val_ratio)), F.lit(1)), n - train - 1)
    short = F.least(n, F.lit(1))
    return F.when(n <= 2, short).otherwise(train).cast("long"), F.when(n <= 2, short).otherwise(train + val).cast("long")


def split_of(row_idx: Column, n: Column, cfg: PrepConfig) -> Column:
    """The split of a row at ``row_idx`` (from 0) of a station's n rows."""
    train_end, val_end = split_ends(n, cfg)
    return F.when(row_idx < train_end, "train").when(row_idx < val_end, "val").otherwise("test")


def chronological_split(table: DataFrame, cfg: PrepConfig) -> DataFrame:
    """``table`` with ``row_idx`` (from 0, by time in its station) and ``split``."""
    station = Window.partitionBy(STATION)
    rows = table.withColumn("row_idx", (F.row_number().over(station.orderBy(TIME)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(station))
    return rows.withColumn("split", split_of(F.col("row_idx"), F.col("_n"), cfg)).drop("_n")


def impute(table: DataFrame, features: list[str]) -> DataFrame:
    """Features filled forward, then backward, inside a station's split. The target is never filled.

    After the forward fill only the leading rows of a split are still null, and they all take the same value: the
    first one that the split has. So it is looked up once over the whole split, and the work grows with the rows.
    """
    order = Window.partitionBy(STATION, "split").orderBy(TIME)
    before, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole)) for c in features}
    return table.withColumns(filled)


def complete_rows(imputed: DataFrame, features: list[str], cfg: PrepConfig) -> DataFrame:
    """Rows with the target and all features, as 32-bit floats."""
    kept = imputed.dropna(subset=[cfg.target, *features])
    return kept.withColumns({c: F.col(c).cast("float") for c in [cfg.target, *features]})


def clean_splits(hourly: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Hourly rows to complete rows of each split. One exchange, on the station, serves every step."""
    features = feature_columns([*hourly.columns, *occupancy(hourly.columns), *calendar(F.col(TIME))], cfg.target)
    return complete_rows(impute(chronological_split(add_features(hourly), cfg), features), features, cfg)


def window_count(n: Column, cfg: PrepConfig) -> Column:
    return F.greatest(n - (cfg.window + cfg.horizon - 1), F.lit(0)).cast("long")


def split_stats(table: DataFrame, clean: DataFrame, cfg: PrepConfig) -> DataFrame:
    """One row for each station: raw, clean and dropped rows and windows of each split, zeros shown.

    ``table`` is the hourly table, of which only the stations are read: the rows of a split follow from a
    station's number of rows.
    """
    raw = table.groupBy(STATION).agg(F.count(F.lit(1)).alias("_n"))
    train_end, val_end = split_ends(F.col("_n"), cfg)
    raw = raw.select(STATION, train_end.alias("train_rows_raw"), (val_end - train_end).alias("val_rows_raw"), (F.col("_n") - val_end).alias("test_rows_raw"))
    kept = clean.groupBy(STATION).agg(*(F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_rows_clean") for s in SPLITS))
    joined = raw.join(kept, STATION, "left").na.fill(0)
    out = [STATION]
    for s in SPLITS:
        out += [f"{s}_rows_raw", f"{s}_rows_clean", (F.col(f"{s}_rows_raw") - F.col(f"{s}_rows_clean")).alias(f"{s}_rows_dropped"), window_count(F.col(f"{s}_rows_clean"), cfg).alias(f"{s}_windows")]
    return joined.select(*out)


def valid_stations(clean: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Stations with at least one train window, and how many."""
    counts = clean.groupBy(STATION).agg(window_count(F.count(F.when(F.col("split") == "train", 1)), cfg).alias("train_windows"))
    return counts.filter("train_windows > 0")


def keep_valid(clean: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Complete rows of the valid stations, in all splits."""
    if "train_rows" in clean.columns:
        return clean.filter(F.col("train_rows") >= cfg.span)
    # The number of train rows is counted over the partitioning that the rows have already.
    train = F.count(F.when(F.col("split") == "train", 1)).over(Window.partitionBy(STATION))
    return clean.withColumn("_train", train).filter(F.col("_train") >= cfg.span).drop("_train")


def with_position(clean: DataFrame) -> DataFrame:
    """``rn`` (from 1) and ``n`` of each row in its station's split."""
    group = Window.partitionBy(STATION, "split")
    return clean.withColumn("rn", F.row_number().over(group.orderBy(TIME)).cast("long")).withColumn("n", F.count(F.lit(1)).over(group))


def multiplicity(cfg: PrepConfig, position: Column, n: Column) -> Column:
    """How many windows of a split of n rows hold its row at ``position`` (from 0)."""
    first = F.greatest(position - (cfg.window - 1), F.lit(0))
    last = F.least(position, n - cfg.window - cfg.horizon)
    return F.greatest(last - first + 1, F.lit(0)).cast("long")


def _train_moments(weighted: DataFrame, features: list[str]) -> DataFrame:
    """Weight, means and squares around them of blocks of a station's train rows, from one pass over the rows.

    A block is a piece of one station that is in one place already. Its mean comes first, and squares are of what
    is left over it, so large values cost no precision.
    """
    block = Window.partitionBy(STATION, "_block")
    rows = weighted.withColumns({"_block": F.floor((F.col("rn") - 1) / MOMENT_ROWS), **{c: F.col(c).cast("double") for c in features}})
    rows = rows.withColumn("_weight", F.sum("m").over(block).cast("double"))
    rows = rows.withColumns({f"_mean_{c}": F.sum(F.col("m") * F.col(c)).over(block) / F.col("_weight") for c in features})
    left = lambda c: F.col(c) - F.col(f"_mean_{c}")
    return rows.groupBy(STATION, "_block").agg(F.first("_weight").alias("_weight"), *(F.first(f"_mean_{c}").alias(f"_mean_{c}") for c in features), *(F.sum(F.col("m") * left(c) * left(c)).alias(f"_squares_{c}") for c in features))


def fit_scaler(clean: DataFrame, features: list[str], cfg: PrepConfig) -> DataFrame:
    """``feature, center, scale`` over the rows of all train windows, a row counted once for each window.

    Windows are not made: rows carry the number of windows that hold them. The rows are read once, for the moments of
    blocks of them; those of all are the blocks' squares and the weighted squares of their means around the mean
    of all, from two looks at one row a block. Constant features get scale 1; without any train window there is no row.
    """
    train = clean.filter(F.col("split") == "train")
    placed = train if {"rn", "n"} <= set(clean.columns) else with_position(train)
    weighted = placed.withColumn("m", multiplicity(cfg, F.col("rn") - 1, F.col("n"))).filter("m > 0")

    def rows(sums: DataFrame, center, scale) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), center(c).alias("center"), scale(c).alias("scale")) for c in features)))
        return sums.select(pairs.alias("p")).select("p.*").filter("center is not null")

    if cfg.scaler == "minmax":
        x = {c: F.col(c).cast("double") for c in features}
        ends = weighted.agg(*(F.min(v).alias(f"low_{c}") for c, v in x.items()), *(F.max(v).alias(f"high_{c}") for c, v in x.items()))
        span = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}")
        return rows(ends, lambda c: F.col(f"low_{c}"), lambda c: F.when(span(c) < 10 * _EPSILON, F.lit(1.0)).otherwise(span(c)))
    blocks = materialized(_train_moments(weighted, features))
    weight = F.sum("_weight")
    means = blocks.agg(*((F.sum(F.col("_weight") * F.col(f"_mean_{c}")) / weight).alias(c) for c in features)).first()
    mean = lambda c: F.lit(means[c]).cast("double")
    step = lambda c: F.col(f"_mean_{c}") - mean(c)
    sums = blocks.agg(weight.alias("_weight"), *((F.sum(F.col(f"_squares_{c}") + F.col("_weight") * step(c) * step(c)) / weight).alias(f"_spread_{c}") for c in features))

    def scale(c: str) -> Column:
        spread = F.col(f"_spread_{c}")
        least = F.col("_weight") * _EPSILON * spread + F.pow(F.col("_weight") * _EPSILON * mean(c), F.lit(2.0))
        return F.when(spread <= least, F.lit(1.0)).otherwise(F.sqrt(spread))

    return rows(sums, mean, scale)


def require_scaler(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The scaler's few rows as a dict; an error where no train window was there to fit on."""
    found = {r.feature: (r.center, r.scale) for r in scaler.collect()}
    if not found:
        raise RuntimeError("no train windows to fit a scaler on")
    return found


def apply_scaler(clean: DataFrame, scaler: DataFrame | dict[str, tuple[float, float]], features: list[str]) -> DataFrame:
    """Features as (x - center) / scale in 32-bit floats; the target is left as it is."""
    known = scaler if isinstance(scaler, dict) else require_scaler(scaler)
    return clean.withColumns({c: ((F.col(c).cast("double") - F.lit(known[c][0])) / F.lit(known[c][1])).cast("float") for c in features})


def sliding_windows(clean: DataFrame, features: list[str], cfg: PrepConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """One row for each sample: ``X`` (window rows of features), ``y``, ``t`` and its station and split.

    Windows count rows of the cleaned split, not hours, and end ``horizon`` rows before their target. ``series`` names
    the columns whose groups they are made in: station and split, or those and the block of :func:`chunks.overlapping`.
    """
    group = Window.partitionBy(*series).orderBy(TIME)
    rows = clean.withColumn("_rn", F.row_number().over(group))
    history = F.collect_list(F.array(*(F.col(c).cast("float") for c in features))).over(group.rowsBetween(-(cfg.span - 1), -cfg.horizon))
    made = rows.withColumn("X", history).filter(F.col("_rn") >= cfg.span)
    return made.select(STATION, "split", F.col(TIME).alias("t"), "X", F.col(cfg.target).cast("float").alias("y"))


def sample_explained(clean: DataFrame, cfg: PrepConfig, samples: int = 1) -> DataFrame:
    """The first ``samples`` windows of each station's train split in long form, history rows and target row."""
    rows = with_position(clean.filter(F.col("split") == "train")).filter(F.col("n") >= cfg.span)
    first = F.sequence(F.greatest(F.col("rn") - (cfg.span - 1), F.lit(1)), F.least(F.col("rn"), F.lit(samples).cast("long"), F.col("n") - (cfg.span - 1)))
    near = rows.filter(F.col("rn") <= samples + cfg.span - 1)
    spread = near.withColumn("sample", F.explode(F.when(F.greatest(F.col("rn") - (cfg.span - 1), F.lit(1)) <= F.least(F.col("rn"), F.lit(samples).cast("long"), F.col("n") - (cfg.span - 1)), first)))
    step = F.col("rn") - F.col("sample")
    role = F.when(step < cfg.window, "history").when(step == cfg.span - 1, "target")
    return spread.withColumn("role", role).filter("role is not null").select(STATION, "sample", step.alias("step"), TIME, F.col(cfg.target).alias("value"), "role")


def non_finite_windows(windows: DataFrame) -> DataFrame:
    """Stations and splits with a window that holds a value that is not finite, and how many."""
    bad = F.exists(F.flatten("X"), lambda x: ~finite(x.cast("double"))) | ~finite(F.col("y").cast("double"))
    return windows.filter(bad).groupBy(STATION, "split").agg(F.count(F.lit(1)).alias("windows"))


def window_violations(windows: DataFrame, cfg: PrepConfig, feature_count: int) -> DataFrame:
    """Per station and split: windows of a wrong length, with rows of a wrong width, or not finite; rows with any."""
    length = (F.size("X") != cfg.window).cast("long")
    width = (~F.forall("X", lambda r: F.size(r) == feature_count)).cast("long")
    finite_ = (F.exists(F.flatten("X"), lambda x: ~finite(x.cast("double"))) | ~finite(F.col("y").cast("double"))).cast("long")
    counts = windows.groupBy(STATION, "split").agg(F.count(F.lit(1)).alias("windows"), F.sum(length).alias("wrong_length"), F.sum(width).alias("wrong_width"), F.sum(finite_).alias("not_finite"))
    return counts.filter("wrong_length + wrong_width + not_finite > 0")
