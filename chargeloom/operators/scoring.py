"""Naive forecasts, prediction errors, metrics, and what a training history says."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, PrepConfig
from ..functions.columns import finite

LAST_VALUE, SEASONAL = "naive_last_value", "naive_seasonal_24h"
PREDICTION_COLUMNS = ("t", STATION, "y_true", "y_pred", "error", "abs_error", "method_name")


def naive_predictions(clean: DataFrame, cfg: PrepConfig, series: Sequence[str] = (STATION, "split")) -> DataFrame:
    """Both naive forecasts of every sample: the last value before the target's horizon, and the window's first.

    Values pass through 32-bit floats and are scored as doubles. Both methods come from one pass. ``series`` is as for
    :func:`chargeloom.operators.dataset.sliding_windows`.
    """
    group = Window.partitionBy(*series).orderBy(TIME)
    y = F.col(cfg.target).cast("float").cast("double")
    rows = clean.select(STATION, "split", F.col(TIME).alias("t"), y.alias("y_true"), F.row_number().over(group).alias("_rn"), F.lag(y, cfg.horizon).over(group).alias("_last"), F.lag(y, cfg.span - 1).over(group).alias("_first"))
    methods = F.explode(F.array(F.struct(F.lit(LAST_VALUE).alias("method_name"), F.col("_last").alias("y_pred")), F.struct(F.lit(SEASONAL).alias("method_name"), F.col("_first").alias("y_pred"))))
    made = rows.filter(F.col("_rn") >= cfg.span).withColumn("_m", methods)
    return with_errors(made.select(STATION, "split", "t", "y_true", "_m.method_name", "_m.y_pred"))


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("y_pred") - F.col("y_true")
    return predictions.withColumns({"error": error, "abs_error": F.abs(error)})


def require_finite(predictions: DataFrame) -> DataFrame:
    """``predictions``; a row that is not finite fails the job when it is read."""
    good = finite(F.col("y_true")) & finite(F.col("y_pred"))
    return predictions.withColumn("y_true", F.when(good, F.col("y_true")).otherwise(F.raise_error(F.lit("predictions must be finite")).cast("double")))


def stack_predictions(*methods: DataFrame) -> DataFrame:
    out = methods[0]
    for m in methods[1:]:
        out = out.unionByName(m)
    return out


def regression_metrics(predictions: DataFrame, keys: list[str], splits: list[str] | None = None) -> DataFrame:
    """``rmse``, ``mae``, ``r2``, ``mse`` and ``sample_count`` for each group of ``keys``, in one pass.

    R2 of targets that do not vary is 1 for perfect predictions, else 0; of fewer than two samples it is
    not-a-number. With ``splits`` (and ``split`` among the keys) absent ones get not-a-number and 0 samples.
    """
    error = F.col("y_pred") - F.col("y_true")
    sums = require_finite(predictions).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("_sse"), F.regr_syy("y_true", "y_true").alias("_sst"), (F.min("y_true") == F.max("y_true")).alias("_flat")
    )
    flat = F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("sample_count") < 2, F.lit(float("nan"))).when(F.col("_flat") | (F.col("_sst") == 0), flat).otherwise(1 - F.col("_sse") / F.col("_sst"))
    found = sums.select(*keys, F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mse", "sample_count")
    if splits is None:
        return found
    rest = [k for k in keys if k != "split"]
    grid = found.select(*rest).distinct().withColumn("split", F.explode(F.array(*map(F.lit, splits))))
    nan = F.lit(float("nan"))
    return grid.join(found, keys, "left").select(*keys, *(F.coalesce(c, nan).alias(c) for c in ("rmse", "mae", "r2", "mse")), F.coalesce("sample_count", F.lit(0)).alias("sample_count"))


def _beats(value: Column, best: Column | None = None) -> Column:
    """Whether a value is lower than the best so far (infinity at first); null and not-a-number never are."""
    return F.coalesce(value.cast("double") < (F.lit(math.inf) if best is None else best), F.lit(False))


def best_epoch(history: DataFrame, run: str = "run", step: str = "epoch", value: str = "val_rmse") -> DataFrame:
    """The first step with the lowest value of each run; a run that has none fails the job.

    Values that are null, not-a-number or infinite count as none.
    """
    usable = F.when(_beats(F.col(value)), F.struct(F.col(value), F.col(step)))
    best = history.groupBy(run).agg(F.min(usable).alias("_best"))
    none = F.raise_error(F.concat(F.lit("no finite value in run "), F.col(run).cast("string")))
    return best.select(run, F.when(F.col("_best").isNull(), none.cast("bigint")).otherwise(F.col(f"_best.{step}").cast("bigint")).alias(f"best_{step}"), F.col(f"_best.{value}").alias(f"best_{value}"))


def early_stop(history: DataFrame, patience: int, run: str = "run", step: str = "epoch", value: str = "val_rmse") -> DataFrame:
    """Where each run stops: after ``patience`` steps in a row without a strictly lower value, else at its last."""
    order = Window.partitionBy(run).orderBy(step)
    before = F.min(F.when(_beats(F.col(value)), F.col(value))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    improved = _beats(F.col(value), F.coalesce(before, F.lit(math.inf)))
    marked = history.withColumn("_better", improved)
    marked = marked.withColumn("_n", F.row_number().over(order))
    # Before any improvement the count runs from the start.
    last = F.coalesce(F.max(F.when(F.col("_better"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    waited = marked.withColumn("_waited", F.col("_n") - last)
    stops = F.min(F.when(F.col("_waited") >= patience, F.col(step)))
    return waited.groupBy(run).agg(F.coalesce(stops, F.max(step)).cast("bigint").alias("stopped_at"), stops.isNotNull().alias("stopped_early"))


def training_summary(history: DataFrame, patience: int, run: str = "run", step: str = "epoch", value: str = "val_rmse") -> tuple[DataFrame, DataFrame]:
    """``(history, summary)`` of runs that stop early: the steps up to where each stops, and one row a run.

    The summary has the first best step among them and its value, the steps done, and whether it stopped early. A run
    without any finite value fails the job.
    """
    stops = early_stop(history, patience, run, step, value)
    done = history.join(stops, run).filter(F.col(step) <= F.col("stopped_at")).drop("stopped_at", "stopped_early")
    steps = done.groupBy(run).agg(F.count(F.lit(1)).alias("steps"))
    return done, best_epoch(done, run, step, value).join(stops, run).join(steps, run)


def short_predictions(predictions: DataFrame) -> DataFrame:
    """``t, station_id, y_true, y_pred, method``."""
    return predictions.select("t", STATION, "y_true", "y_pred", F.col("method_name").alias("method"))


def canonical(predictions: DataFrame) -> DataFrame:
    return predictions.select(*PREDICTION_COLUMNS)


def format_time(t: Column, nanoseconds: bool = False) -> Column:
    """A time as the written tables have it: with a blank, or with T and nine decimals."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000")) if nanoseconds else F.date_format(t, "yyyy-MM-dd HH:mm:ss")
