"""Parsing and feature functions on columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TIME_FORMAT

#: Text that counts as a number: decimal with optional exponent, or an infinity.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def parse_number(text: Column) -> Column:
    """Text to double, null where it is no number. Not-a-number becomes null (the pattern has no such word); infinities stay."""
    return F.when(text.cast("string").rlike(NUMBER), text.cast("string").try_cast("double"))


def number(column: Column, of: T.DataType) -> Column:
    """A column of any type as doubles: text as :func:`parse_number` has it, not-a-number as null."""
    return parse_number(column) if isinstance(of, T.StringType) else F.nullif(column.cast("double"), F.lit(math.nan))


def parse_time(text: Column, formats: Sequence[str] = (TIME_FORMAT,)) -> Column:
    """Text to a time without zone by the first of ``formats`` that it has, null where it has none."""
    return F.coalesce(*(F.try_to_timestamp(text.cast("string"), F.lit(f)) for f in formats)).cast("timestamp_ntz")


def finite(value: Column) -> Column:
    """Whether a value is neither null, nor not-a-number, nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; 0.0 where either is not finite or b is zero."""
    return F.when(finite(a) & finite(b) & (b != 0), a / b).otherwise(F.lit(0.0))


def occupancy(columns: list[str]) -> dict[str, Column]:
    """Busy shares of busy and idle, for the pairs that the columns hold."""
    out = {}
    for prefix in ("", "fast_", "slow_"):
        busy, idle = f"{prefix}busy", f"{prefix}idle"
        if busy in columns and idle in columns:
            out[f"{prefix}occupancy_rate"] = safe_divide(F.col(busy).cast("double"), F.col(busy).cast("double") + F.col(idle).cast("double"))
    return out


def calendar(time: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), weekend flag, and both as points on a circle."""
    hour, day = F.hour(time), F.weekday(time)
    turn = 2 * math.pi
    return {
        "hour": hour.cast("smallint"),
        "day_of_week": day.cast("smallint"),
        "is_weekend": (day >= 5).cast("tinyint"),
        "hour_sin": F.sin(F.lit(turn) * hour / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(turn) * hour / F.lit(24.0)),
        "dow_sin": F.sin(F.lit(turn) * day / F.lit(7.0)),
        "dow_cos": F.cos(F.lit(turn) * day / F.lit(7.0)),
    }


def megabytes(size: Column) -> Column:
    return size / F.lit(1024 * 1024)
