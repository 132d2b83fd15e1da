"""Checks between the parts of an experiment: the task's settings and its universe of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STATION, PrepConfig
from . import results

#: The official task.
OFFICIAL_TASK = {"window_size": 24, "horizon": 1, "target_column": "volume", "feature_count": 19}


def check_task(metadata: dict, official: dict | None = None) -> None:
    """An error that names every setting that is not the supported one."""
    wrong = [f"{k} is {metadata.get(k)!r}, not {v!r}" for k, v in (official or OFFICIAL_TASK).items() if metadata.get(k) != v]
    if wrong:
        raise ValueError("unsupported task: " + "; ".join(wrong))


def task_violations(metadata: DataFrame, official: dict | None = None) -> DataFrame:
    """``setting, found, supported`` of every setting of a metadata row that is not the supported one, as text."""
    pairs = F.array(*(F.struct(F.lit(k).alias("setting"), F.col(k).cast("string").alias("found"), F.lit(str(v)).alias("supported")) for k, v in (official or OFFICIAL_TASK).items()))
    return metadata.select(F.explode(pairs).alias("s")).select("s.*").filter(~F.col("found").eqNullSafe(F.col("supported")))


def task_settings(cfg: PrepConfig, features: list[str]) -> dict:
    return {"window_size": cfg.window, "horizon": cfg.horizon, "target_column": cfg.target, "feature_count": len(features)}


def sample_universe(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Splits whose samples or stations differ from ``expected(split, samples, stations, digest)``; none if all is well.

    Sets of stations are compared by their :func:`chargeloom.operators.results.digest`, so as many other stations differ.
    """
    own = samples.groupBy("split", STATION).agg(F.count(F.lit(1)).alias("_n")).groupBy("split")
    actual = own.agg(F.sum("_n").alias("actual_samples"), F.count(F.lit(1)).alias("actual_stations"), results.digest(F.col(STATION)).alias("actual_digest"))
    names = ("samples", "stations", "digest")
    both = actual.join(expected.withColumnsRenamed({c: f"expected_{c}" for c in names}), "split", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"actual_{c}").eqNullSafe(F.col(f"expected_{c}"))
    return both.filter(~same).select("split", *(f"{side}_{c}" for c in names for side in ("actual", "expected")))


def check_stations(found: DataFrame, expected: DataFrame, digest: str | None = None) -> None:
    """An error that names some stations that only one of two tables has.

    With the ``digest`` of the expected ones, names are only looked at where it is not that of those found.
    """
    if digest is not None and results.universe(found).first().station_digest == digest:
        return
    here, there = found.select(STATION), expected.select(STATION)
    extra = [r[0] for r in here.join(there, STATION, "left_anti").orderBy(STATION).limit(5).collect()]
    lost = [r[0] for r in there.join(here, STATION, "left_anti").orderBy(STATION).limit(5).collect()]
    if extra or lost or digest is not None:
        raise ValueError(f"stations differ: {extra} are not expected, {lost} are not there")


def check_features(found: list[str], expected: list[str]) -> None:
    if list(found) != list(expected):
        raise ValueError(f"features differ: {found} and {expected}")


def require_rows(table: DataFrame, what: str) -> DataFrame:
    """``table``; an error if it is empty."""
    if table.isEmpty():
        raise RuntimeError(f"no {what}")
    return table
