"""Column names and the settings of a run."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

STATION = "station_id"
TIME = "time"

# Measurement columns in their canonical order, and those that an hour adds up.
VALUE_COLUMNS = ("busy", "idle", "fast_busy", "fast_idle", "slow_busy", "slow_idle", "duration", "volume", "s_price", "e_price")
SUMMED_COLUMNS = ("duration", "volume")

OCCUPANCY_COLUMNS = ("occupancy_rate", "fast_occupancy_rate", "slow_occupancy_rate")
CALENDAR_COLUMNS = ("hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos")

#: How times are written: the plain form, and further ones that are tried in this order where it does not fit.
TIME_FORMAT = "yyyy-M-d H:m:s"
TIME_FORMATS = (TIME_FORMAT, "yyyy-M-d'T'H:m:s", "yyyy-M-d[ ]['T']H:m:s.SSSSSS", "yyyy/M/d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m", "yyyy-M-d", "yyyy/M/d")

SPLITS = ("train", "val", "test")
SCALERS = ("standard", "minmax")


@dataclass(frozen=True)
class PrepConfig:
    """Settings of dataset preparation; all faults of a configuration are reported together when it is made."""

    target: str = "volume"
    window: int = 24
    horizon: int = 1
    train_ratio: float = 0.70
    val_ratio: float = 0.05
    test_ratio: float = 0.25
    seed: int = 42
    scaler: str = "standard"
    iid_clients: int | None = None
    #: Width of a row of the rolled-up table; slots are counted from 1970-01-01 00:00.
    frequency: str = "1 hour"
    #: Patterns of times in text, tried in order.
    time_formats: tuple[str, ...] = TIME_FORMATS
    #: A gap between two readings of a station longer than this many hours fails the job; None checks nothing.
    max_span_hours: int | None = None

    def __post_init__(self) -> None:
        if faults := list(self._faults()):
            raise ValueError("bad configuration: " + "; ".join(faults))

    def _faults(self) -> Iterator[str]:
        for name in ("window", "horizon", "iid_clients", "max_span_hours"):
            value = getattr(self, name)
            if value is not None and value < (name != "max_span_hours"):
                yield f"{name} is {value}"
        ratios = self.ratios.values()
        if min(ratios) < 0 or not math.isclose(math.fsum(ratios), 1, rel_tol=0, abs_tol=1e-9):
            yield f"the split ratios {self.ratios} are no shares of 1"
        if self.scaler not in SCALERS:
            yield f"scaler {self.scaler!r} is none of {SCALERS}"
        if self.target not in VALUE_COLUMNS:
            yield f"target {self.target!r} is no measurement"
        if not re.fullmatch(r"[1-9]\d* (minute|hour|day)s?", self.frequency):
            yield f"frequency {self.frequency!r} is no number of minutes, hours or days"

    @property
    def ratios(self) -> dict[str, float]:
        return dict(zip(SPLITS, (self.train_ratio, self.val_ratio, self.test_ratio)))

    @property
    def span(self) -> int:
        """Rows from the first row of a window to its target."""
        return self.window + self.horizon


def feature_columns(columns: list[str] | tuple[str, ...], target: str = "volume") -> list[str]:
    """The features that a table has, in canonical order; the target's own history is none."""
    names = [c for c in VALUE_COLUMNS if c != target] + [*OCCUPANCY_COLUMNS, *CALENDAR_COLUMNS]
    return [c for c in names if c in columns]
