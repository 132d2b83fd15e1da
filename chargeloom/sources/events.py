"""An event table seen as raw station readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STATION


def readings_from_events(events: DataFrame, station: str = "event_type") -> DataFrame:
    """Readings as text from ``events(event_id, ts, user_id, event_type, value, props)``.

    ``station`` names the column that stands for the station. Times are cut to five minutes, which makes true
    duplicates; the measures come from ``props.k``; some times and values are spoilt by rule of the event id,
    so that every cleaning rule has work.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    cut = F.concat(F.date_format("ts", "yyyy-MM-dd HH:"), F.lpad((F.floor(F.minute("ts") / 5) * 5).cast("string"), 2, "0"), F.lit(":00"))
    rows = events.withColumn("k", k)
    columns = {
        "busy": F.when(event % 13 != 0, F.col("k") % 7),
        "idle": F.col("k") % 5,
        "fast_busy": F.col("k") % 3,
        "fast_idle": F.col("k") % 4,
        "slow_busy": F.col("k") % 2,
        "slow_idle": F.col("k") % 6,
        "duration": F.col("k") * 5,
        "s_price": F.lit(0.5) + (F.col("k") % 10) / F.lit(10.0),
        "e_price": F.lit(0.3) + (F.col("k") % 4) / F.lit(10.0),
    }
    volume = F.when(event % 31 == 0, F.lit("bad")).when(event % 23 == 0, F.lit(None)).otherwise(F.col("value").cast("string"))
    time = F.when(event % 101 == 0, F.lit("not-a-time")).otherwise(cut)
    return rows.select(F.col(station).cast("string").alias(STATION), time.alias("time"), volume.alias("volume"), *(c.cast("string").alias(n) for n, c in columns.items()))
