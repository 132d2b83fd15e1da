"""Samples dealt to clients: pooled, one client a station, or balanced chunks of shuffled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SPLITS, STATION
from ..sources.scratch import materialized

CENTRALIZED, STATION_CLIENTS, IID = "centralized", "non_iid_station", "iid"
CLIENT = "client_"
#: Folders that the windows of balanced clients are dealt to.
BUCKETS = 256


def centralized(windows: DataFrame) -> DataFrame:
    """All stations pooled: the one client ``all``."""
    return windows.withColumns({"scenario": F.lit(CENTRALIZED), "client_id": F.lit("all")})


def station_clients(windows: DataFrame) -> DataFrame:
    """One client for each station."""
    return windows.withColumns({"scenario": F.lit(STATION_CLIENTS), "client_id": F.concat(F.lit(CLIENT), F.col(STATION))})


def client_name(number: Column) -> Column:
    return F.format_string(f"{CLIENT}%03d", number)


def client_bucket(client_id: Column) -> Column:
    """The folder that holds a balanced client's windows: its number modulo ``BUCKETS``."""
    return F.substring(client_id, len(CLIENT) + 1, 20).cast("bigint") % BUCKETS


def _chunk(position: Column, n: Column, clients: int) -> Column:
    """The chunk of a 0-based position when n samples go to so many chunks in order, the first n mod k one larger."""
    base, rest = F.floor(n / clients).cast("long"), n % clients
    large = rest * (base + 1)
    behind = F.when(base > 0, rest + F.floor((position - large) / F.greatest(base, F.lit(1))))
    return F.when(position < large, F.floor(position / (base + 1))).otherwise(behind).cast("int")


def global_positions(rows: DataFrame, split: str, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 0, by group and order within each split) and ``split_rows``.

    A row's position is its group's offset and its place in the group. Offsets are a prefix sum in two levels: group
    sizes (one row a station, or a digest prefix) lie in ranges, each range adds up its own, and what comes before a
    range is a sum over one row a range. So no task holds a split, or all its groups.
    """
    inside = Window.partitionBy(split, group).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    sizes = rows.groupBy(split, group).agg(F.count(F.lit(1)).alias("_size"))
    ranged = materialized(sizes.repartitionByRange(split, group).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(split).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(split, "_range").agg(F.sum("_size").alias("_total"))
    # A row for each range and split: no more than there are partitions.
    starts = totals.select(split, "_range", (F.sum("_total").over(before) - F.col("_total")).alias("_start"), F.sum("_total").over(Window.partitionBy(split)).alias("split_rows"))
    own = Window.partitionBy(split, "_range").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_size").over(own) - F.col("_size"))
    offsets = local.join(F.broadcast(starts), [split, "_range"]).select(split, group, (F.col("_start") + F.col("_local")).alias("_offset"), "split_rows")
    return placed.join(offsets, [split, group]).withColumn("position", F.col("_offset") + F.col("_place")).drop("_place", "_offset")


def shuffle_key(seed: int) -> Column:
    """What train samples are ordered by: a digest of seed, station and time, alike on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(STATION), F.date_format("t", "yyyy-MM-dd HH:mm:ss")))


def iid_assignment(samples: DataFrame, clients: int, seed: int) -> DataFrame:
    """``split, station_id, t, position, client_id``: train shuffled by seed, val and test by station and time.

    Works on the samples' keys alone; join it to the windows last.
    """
    if clients <= 0:
        raise ValueError("the number of clients must be positive")
    keys = samples.select("split", STATION, "t").withColumn("_digest", F.when(F.col("split") == "train", shuffle_key(seed)).otherwise(F.lit("")))
    group = F.when(F.col("split") == "train", F.substring("_digest", 1, 4)).otherwise(F.col(STATION))
    placed = global_positions(keys.withColumn("_group", group), "split", "_group", ["_digest", STATION, "t"])
    return placed.select("split", STATION, "t", "position", client_name(_chunk(F.col("position"), F.col("split_rows"), clients)).alias("client_id"))


def iid_clients(windows: DataFrame, clients: int, seed: int) -> DataFrame:
    """The windows with their ``scenario`` and balanced ``client_id``."""
    assigned = iid_assignment(windows, clients, seed).drop("position")
    return windows.join(assigned, ["split", STATION, "t"]).withColumn("scenario", F.lit(IID))


def roster(spark: SparkSession, number: int) -> DataFrame:
    """The names of all balanced clients, also of those that get no sample."""
    return spark.range(number).select(client_name(F.col("id")).alias("client_id"))


def client_counts(samples: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Samples of each client and split, zeros shown; ``clients(client_id)`` adds clients without any."""
    names = samples.select("client_id").distinct() if clients is None else clients
    grid = names.withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    counts = samples.groupBy("client_id", "split").agg(F.count(F.lit(1)).alias("samples"))
    return grid.join(counts, ["client_id", "split"], "left").select("client_id", "split", F.coalesce("samples", F.lit(0)).alias("samples"))


def layout_counts(samples: DataFrame, assigned: DataFrame, clients: DataFrame) -> DataFrame:
    """``scenario, client_id, split, samples`` of all three layouts of ``samples(split, station_id, t)``."""
    parts = (
        (CENTRALIZED, client_counts(centralized(samples))),
        (IID, client_counts(assigned, clients)),
        (STATION_CLIENTS, client_counts(station_clients(samples))),
    )
    tables = [counts.select(F.lit(scenario).alias("scenario"), "client_id", "split", "samples") for scenario, counts in parts]
    return tables[0].union(tables[1]).union(tables[2])


def client_summary(samples: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Samples and first and last target time of each split, and the stations behind a client's train samples.

    ``clients(client_id)`` adds clients without any sample.
    """
    here = {s: F.col("split") == s for s in SPLITS}
    if clients is not None:
        samples = clients.join(samples, "client_id", "left")
    return samples.groupBy("client_id").agg(
        *(F.count(F.when(c, 1)).alias(f"{s}_samples") for s, c in here.items()),
        F.countDistinct(F.when(here["train"], F.col(STATION))).alias("train_station_count"),
        *(f(F.when(c, F.col("t"))).alias(f"{s}_{name}_t") for s, c in here.items() for name, f in (("min", F.min), ("max", F.max))),
    )


def usable_clients(summary: DataFrame) -> DataFrame:
    """Clients with val and test samples; ``trains`` tells whether they have train samples too."""
    return summary.filter("val_samples > 0 and test_samples > 0").select("client_id", (F.col("train_samples") > 0).alias("trains"))


def keep_usable(samples: DataFrame) -> DataFrame:
    """The samples of usable clients."""
    return samples.join(usable_clients(client_summary(samples)).select("client_id"), "client_id", "left_semi")


def merge_clients(samples: DataFrame, split: str) -> DataFrame:
    """One split of all clients together."""
    return samples.filter(F.col("split") == split)


def first_k(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)
