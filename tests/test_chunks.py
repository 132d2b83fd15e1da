"""Long stations by chunks against the plain plan."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chargeloom.config import VALUE_COLUMNS, PrepConfig, feature_columns
from chargeloom.jobs import prepare
from chargeloom.operators import chunks, dataset, scoring
from chargeloom.sources import tables

START = dt.datetime(2020, 2, 28)
BLOCK = (*dataset.SERIES, "block")


def stations(spark, lengths, frequency="HOUR"):
    """An hourly table with runs of missing values, long ones too, that differ by station and column."""
    rows = spark.createDataFrame(list(lengths.items()), "station_id string, size int").select("station_id", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    time = F.timestamp_add(frequency, F.col("i"), F.lit(START).cast("timestamp_ntz"))
    hole = lambda k: F.pmod(F.xxhash64("station_id", F.floor(F.col("i") / (5 + 13 * k)), F.lit(k)), F.lit(10)) < k % 5 + 1
    values = [F.when(~hole(k), F.pmod(F.xxhash64("station_id", "i", F.lit(k)), F.lit(1000)).cast("double")).alias(c) for k, c in enumerate(VALUE_COLUMNS)]
    return rows.select("station_id", time.alias("time"), *values)


def same(a, b):
    columns = sorted(set(a.columns) & set(b.columns))
    text = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert text(a) == text(b)


@pytest.mark.parametrize(("rows", "cfg"), [(40, PrepConfig(window=6, horizon=2)), (7, PrepConfig(window=6, horizon=2)), (1000, PrepConfig()), (64, PrepConfig(frequency="30 minutes"))])
def test_chunks_are_the_plain_plan(spark, rows, cfg):
    table = stations(spark, {"a": 700, "b": 30, "c": 3, "d": 1, "e": 2, "f": 333})
    features = feature_columns([*table.columns, "occupancy_rate", "hour"])
    plain, cut = dataset.clean_splits(table, cfg), chunks.clean_splits(table, cfg, rows)
    assert "busy" in features and cut.count() > 0
    same(plain, cut)
    same(dataset.with_position(plain), cut)
    a, b = dataset.keep_valid(plain, cfg), chunks.overlapping(dataset.keep_valid(cut, cfg), cfg, max(rows, cfg.span))
    same(dataset.sliding_windows(a, features, cfg), dataset.sliding_windows(b, features, cfg, BLOCK))
    same(scoring.naive_predictions(a, cfg), scoring.naive_predictions(b, cfg, BLOCK))
    for most in (30, 10_000):
        same(dataset.with_position(plain), chunks.complete_rows(table, cfg, most))


def test_no_window_holds_a_long_station(spark):
    """Windows over rows go by chunk or block; those by station alone are over one row a chunk."""
    cfg = PrepConfig(window=6)
    made = dataset.sliding_windows(chunks.overlapping(chunks.clean_splits(stations(spark, {"a": 700}), cfg, 50), cfg, 50), ["busy"], cfg, BLOCK)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows together
    try:
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < made.count()
    with pytest.raises(ValueError, match="shorter"):
        chunks.overlapping(made, cfg, 6)


def test_scaler_is_the_same_on_any_partitioning(spark):
    cfg = PrepConfig(window=6)
    rows = dataset.clean_splits(stations(spark, {"a": 700, "b": 90, "f": 333}), cfg).withColumn("busy", (F.col("busy") + 1e7).cast("float"))
    features = ["busy", "idle", "duration"]
    one = {r.feature: (r.center, r.scale) for r in dataset.fit_scaler(rows, features, cfg).collect()}
    two = {r.feature: (r.center, r.scale) for r in dataset.fit_scaler(rows.repartition(3, "time"), features, cfg).collect()}
    for c in features:
        assert one[c] == pytest.approx(two[c], rel=1e-12)
    samples = [x for r in dataset.sliding_windows(rows.filter("split = 'train'"), ["busy"], cfg).collect() for (x,) in r.X]
    mean = math.fsum(samples) / len(samples)
    assert one["busy"] == pytest.approx((mean, math.sqrt(math.fsum((x - mean) ** 2 for x in samples) / len(samples))), rel=1e-10)


def test_jobs_with_long_stations(spark, tmp_path, monkeypatch):
    """The datasets and scores of a folder are the same whatever counts as long."""
    cfg = PrepConfig(window=6, iid_clients=3)
    tables.write_hourly(stations(spark, {"a": 5000, "b": 80}), f"{tmp_path}/hours")
    found = []
    for rows in (10_000, 700):
        monkeypatch.setattr(chunks.complete_rows, "__defaults__", (rows,))
        monkeypatch.setattr(chunks.overlapping, "__defaults__", (rows,))
        out = f"{tmp_path}/{rows}"
        metadata = prepare.build_datasets(spark, f"{tmp_path}/hours", out, cfg)
        metrics = prepare.score_baselines(spark, f"{tmp_path}/hours", f"{out}/naive", cfg)
        windows = tables.read_samples(spark, f"{out}/windows").select("station_id", "split", "t", "y", F.xxhash64(F.transform(F.flatten("X"), lambda x: F.round(x, 3))).alias("x"))
        found.append((metadata["samples"], metadata["station_digest"], sorted((r.method_name, r.split, r.sample_count, round(r.rmse, 6)) for r in metrics.collect()), sorted(map(repr, windows.collect()))))
    assert found[0] == found[1]
