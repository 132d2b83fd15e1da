"""Raw readings to clean readings, to dense hourly rows, and the quality report of each station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, SUMMED_COLUMNS, TIME, TIME_FORMAT, VALUE_COLUMNS
from ..functions.columns import parse_number, parse_time

HOUR = "1 hour"


def slot_minutes(frequency: str) -> int:
    """The length of a slot, for frequencies as the configuration allows them."""
    number, unit = frequency.split()
    return int(number) * {"minute": 1, "hour": 60, "day": 1440}[unit.removesuffix("s")]


def slot_start(time: Column, frequency: str = HOUR) -> Column:
    """The start of a time's slot, null for null (which a time window would drop); slots count from 1970-01-01 00:00."""
    epoch, minutes = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), slot_minutes(frequency)
    slot = F.floor(F.timestamp_diff("MICROSECOND", epoch, time) / (minutes * 60_000_000))
    return F.timestamp_add("MINUTE", (slot * minutes).cast("int"), epoch)


def parse_readings(raw: DataFrame, formats: Sequence[str] = (TIME_FORMAT,)) -> DataFrame:
    """Readings as text to ``station_id, time, <values>``, null where a text is no time or no number.

    Columns are matched by name: expected ones that are absent are null, others are not read. ``time`` is the
    only one that must be there.
    """
    if TIME not in raw.columns:
        raise ValueError(f"readings without a {TIME} column")
    values = [(parse_number(F.col(c)) if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in VALUE_COLUMNS]
    return raw.select(STATION, parse_time(F.col(TIME), formats).alias(TIME), *values)


def clean_readings(raw: DataFrame, formats: Sequence[str] = (TIME_FORMAT,)) -> DataFrame:
    """:func:`parse_readings` without the rows that have no valid time."""
    return parse_readings(raw, formats).filter(F.col(TIME).isNotNull())


def _rule(column: str) -> Column:
    return (F.sum(column) if column in SUMMED_COLUMNS else F.avg(column)).alias(column)


#: Rows without a valid time are dealt by their task under so many keys a station, as no hour deals them.
_TIMELESS_KEYS = 64


def _empty() -> Column:
    """Whether a reading has no value at all."""
    empty = F.lit(True)
    for c in VALUE_COLUMNS:
        empty = empty & F.col(c).isNull()
    return empty


def collapse_duplicates(clean: DataFrame, partitions: int | None = None, frequency: str = HOUR) -> DataFrame:
    """One row for each station and time (sum or mean by column), with its ``hour`` and the ``rows`` it stands for.

    ``hour`` is the start of the time's slot: an hour, or what ``frequency`` says.

    Rows are dealt by station and hour, not by station: a station with most of the readings is spread over
    its hours, and the hourly rollup needs no further exchange.
    """
    keyed = clean.withColumn("hour", slot_start(F.col(TIME), frequency))
    dealt = keyed.repartition(partitions, STATION, "hour") if partitions else keyed.repartition(STATION, "hour")
    return dealt.groupBy(STATION, "hour", TIME).agg(*map(_rule, VALUE_COLUMNS), F.count(F.lit(1)).alias("rows"))


def rollup_hours(collapsed: DataFrame) -> DataFrame:
    """The hours that have readings: sums or means over the times of the hour (not over raw rows)."""
    return collapsed.groupBy(STATION, "hour").agg(*map(_rule, VALUE_COLUMNS)).withColumnRenamed("hour", TIME)


def profile_hours(raw: DataFrame, frequency: str = HOUR, formats: Sequence[str] = (TIME_FORMAT,)) -> DataFrame:
    """Raw readings to their hours with what the hourly table and the quality report need: one scan, one exchange.

    A row is an hour of a station with its rolled-up values and a profile that adds up: ``rows`` (raw), ``times``
    (distinct), ``all_missing`` and ``missing_<column>``. Rows without a valid time are counted in rows whose ``time``
    is null; they are dealt by the task that read them, so that a station's many wrong times are not one group.
    :func:`hours_of` and :func:`station_report` finish it, any number of times.
    """
    keyed = parse_readings(raw, formats).withColumns({"hour": slot_start(F.col(TIME), frequency), "_deal": F.when(F.col(TIME).isNull(), F.spark_partition_id() % _TIMELESS_KEYS)})
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in VALUE_COLUMNS]
    times = keyed.repartition(STATION, "hour", "_deal").groupBy(STATION, "hour", "_deal", TIME).agg(*map(_rule, VALUE_COLUMNS), F.count(F.lit(1)).alias("rows"), F.sum(_empty().cast("long")).alias("all_missing"), *missing)
    counts = ["rows", "all_missing", *(f"missing_{c}" for c in VALUE_COLUMNS)]
    hours = times.groupBy(STATION, "hour", "_deal").agg(*map(_rule, VALUE_COLUMNS), F.count(TIME).alias("times"), *(F.sum(c).alias(c) for c in counts))
    return hours.withColumnRenamed("hour", TIME).drop("_deal")


def hours_of(profiled: DataFrame) -> DataFrame:
    """The rolled-up hours of a profile."""
    return profiled.filter(F.col(TIME).isNotNull()).select(STATION, TIME, *VALUE_COLUMNS)


def fill_hours(hourly: DataFrame, max_span_hours: int | None = None, frequency: str = HOUR) -> DataFrame:
    """A row for every hour (or slot of ``frequency``) between a station's first and last; the added ones are null.

    Each row is extended up to the next one, so no grid is built and joined. With ``max_span_hours`` a
    station whose gap to the next reading is longer (one wrong date) fails the job.
    """
    step = F.expr(f"interval {frequency}")
    following = F.lead(TIME).over(Window.partitionBy(STATION).orderBy(TIME))
    upto = F.coalesce(following - step, F.col(TIME))
    spread = hourly.withColumn("_last", upto)
    if max_span_hours is not None:
        long = F.timestamp_diff("HOUR", F.col(TIME), F.col("_last")) > max_span_hours
        spread = spread.withColumn("_last", F.when(long, F.raise_error(F.concat(F.lit("a gap is longer than allowed at station "), F.col(STATION))).cast("timestamp_ntz")).otherwise(F.col("_last")))
    own = F.col("_hour") == F.col(TIME)
    rows = spread.withColumn("_hour", F.explode(F.sequence(F.col(TIME), F.col("_last"), step)))
    return rows.select(STATION, F.col("_hour").alias(TIME), *(F.when(own, F.col(c)).alias(c) for c in VALUE_COLUMNS))


def hourly_table(raw: DataFrame, max_span_hours: int | None = None, frequency: str = HOUR) -> DataFrame:
    """Raw readings to the dense hourly table."""
    return fill_hours(rollup_hours(collapse_duplicates(clean_readings(raw), frequency=frequency)), max_span_hours, frequency)


def _counts(prefix: str, available: Column | None = None) -> Column:
    """A map of the columns with missing values to their number, columns without any left out."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, VALUE_COLUMNS)), F.array(*(F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)) for c in VALUE_COLUMNS)))
    keep = lambda k, v: (v > 0) & (F.array_contains(available, k) if available is not None else F.lit(True))
    return F.map_filter(pairs, keep)


def station_report(profiled: DataFrame, headers: DataFrame | None = None, frequency: str = HOUR) -> DataFrame:
    """One row for each station: what cleaning found and what the hourly table holds, from its :func:`profile_hours`.

    ``rows_after_time_cleaning`` counts after repeated times are collapsed, missing values before. With
    ``headers`` (station_id, ``available_columns``, ``missing_columns``, ``unexpected_columns``) columns that a station's file does not
    have are not counted as missing values. A station without any valid time has null bounds and no hours.

    The dense hourly table is not made for this: its rows follow from a station's first and last hour, and those of
    its values that are missing from the values that are there.
    """
    timed = F.col(TIME).isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(timed, F.col(c))), F.lit(0))
    sums = profiled.groupBy(STATION).agg(
        F.sum("rows").alias("rows_before_cleaning"),
        of("times").alias("rows_after_time_cleaning"),
        (F.sum("rows") - of("rows")).alias("invalid_time_rows_dropped"),
        (of("rows") - of("times")).alias("duplicate_timestamps_collapsed"),
        of("all_missing").alias("fully_missing_numeric_rows"),
        F.min(TIME).alias("hourly_start"),
        F.max(TIME).alias("hourly_end"),
        *(of(f"missing_{c}").alias(f"raw_{c}") for c in VALUE_COLUMNS),
        *(F.count(F.when(timed, F.col(c))).alias(f"there_{c}") for c in VALUE_COLUMNS),
    )
    slots = F.floor(F.timestamp_diff("MINUTE", F.col("hourly_start"), F.col("hourly_end")) / slot_minutes(frequency)) + 1
    report = sums.withColumn("rows_after_hourly_aggregation", F.coalesce(slots, F.lit(0)).cast("long"))
    report = report.withColumns({f"hourly_{c}": F.col("rows_after_hourly_aggregation") - F.col(f"there_{c}") for c in VALUE_COLUMNS})
    if headers is not None:
        report = report.join(headers, STATION, "left")
    available = F.col("available_columns") if headers is not None else None
    counts = ("rows_before_cleaning", "rows_after_time_cleaning", "invalid_time_rows_dropped", "duplicate_timestamps_collapsed", "fully_missing_numeric_rows", "rows_after_hourly_aggregation")
    extra = ["available_columns", "missing_columns", "unexpected_columns"] if headers is not None else []
    return report.select(STATION, *counts, _counts("raw_", available).alias("raw_missing_value_counts"), _counts("hourly_", available).alias("hourly_missing_counts"), "hourly_start", "hourly_end", *extra)


def quality_report(raw: DataFrame, headers: DataFrame | None = None, frequency: str = HOUR) -> DataFrame:
    """:func:`station_report` of raw readings, from one scan of them."""
    return station_report(profile_hours(raw, frequency), headers, frequency)


def skipped_stations(report: DataFrame) -> DataFrame:
    """Stations of a :func:`station_report` that yield no hour, and why: all their readings went, or none was there."""
    reason = F.when(F.col("rows_before_cleaning") == 0, "no readings").otherwise("no valid time")
    return report.filter("rows_after_hourly_aggregation = 0").select(STATION, "rows_before_cleaning", reason.alias("reason"))


def run_counters(hourly: DataFrame, discovered: int) -> DataFrame:
    """One row: stations found, stations with hours, hourly rows in all."""
    return hourly.agg(F.lit(discovered).cast("long").alias("stations_discovered"), F.countDistinct(STATION).alias("stations_processed"), F.count(F.lit(1)).alias("hourly_rows"))
