"""Hand-worked cases of the station operators: one for each rule that data can show."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chargeloom.config import VALUE_COLUMNS, PrepConfig, feature_columns
from chargeloom.functions.columns import calendar, parse_number, parse_time, safe_divide
from chargeloom.operators import contracts, dataset, federated, hourly, layouts, results, scoring

DAY = dt.datetime(2024, 1, 1)


def raw(spark, rows):
    """rows of (station, time, busy, volume) as text."""
    return spark.createDataFrame(rows, "station_id string, time string, busy string, volume string")


def hourly_rows(spark, values, station="s", **more):
    """An hourly table of one station: ``values`` are the target, the other columns constant unless given."""
    rows = [(station, DAY + dt.timedelta(hours=i), None if v is None else float(v), *(float(more.get(c, [1.0] * len(values))[i]) if more.get(c, [1.0] * len(values))[i] is not None else None for c in VALUE_COLUMNS if c != "volume")) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, time timestamp_ntz, volume double, " + ", ".join(f"{c} double" for c in VALUE_COLUMNS if c != "volume"))


def test_numbers_and_times_as_text(spark):
    texts = {"1e3": 1000.0, " 12 ": 12.0, "1d": None, "0x1p3": None, "1_0": None, "nan": None, "": None, "inf": math.inf, ".5": 0.5, "-Infinity": -math.inf}
    rows = spark.createDataFrame([(k,) for k in texts], "x string").select("x", parse_number(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == texts
    times = {"2024-01-01 00:05:00": True, "2024-1-1 0:5:0": True, "bad": False, "2024-01-01": False, "2024-01-01T00:05:00": False, " 2024-01-01 00:05:00": False}
    rows = spark.createDataFrame([(k,) for k in times], "x string").select("x", parse_time(F.col("x")).isNotNull().alias("ok")).collect()
    assert {r.x: r.ok for r in rows} == times


def test_collapse_comes_before_rollup(spark):
    rows = raw(spark, [("s", "2024-01-01 00:05:00", "2", "1"), ("s", "2024-01-01 00:05:00", "4", "1"), ("s", "2024-01-01 00:10:00", "9", None)])
    got = hourly.hourly_table(rows).collect()
    assert [(r.busy, r.volume) for r in got] == [(6.0, 2.0)]


def test_empty_hours_and_empty_sums(spark):
    rows = raw(spark, [("s", "2024-01-01 00:10:00", "1", None), ("s", "2024-01-01 02:10:00", "1", "3")])
    got = sorted(dataset.add_features(hourly.hourly_table(rows)).collect(), key=lambda r: r.time)
    assert [(r.busy, r.volume, r.occupancy_rate) for r in got] == [(1.0, None, 0.0), (None, None, 0.0), (1.0, 3.0, 0.0)]
    with pytest.raises(Exception, match="gap"):
        hourly.hourly_table(rows, max_span_hours=0).collect()


def test_quality_report(spark):
    rows = raw(spark, [("s", "2024-01-01 00:05:00", "2", "x"), ("s", "2024-01-01 00:05:00", None, None), ("s", "bad", "1", "1"), ("s", "2024-01-01 02:00:00", "1", "1"), ("t", "bad", "1", "1")])
    got = {r.station_id: r for r in hourly.quality_report(rows).collect()}
    s, t = got["s"], got["t"]
    assert (s.rows_before_cleaning, s.rows_after_time_cleaning, s.invalid_time_rows_dropped, s.duplicate_timestamps_collapsed, s.fully_missing_numeric_rows) == (4, 2, 1, 1, 1)
    assert s.raw_missing_value_counts["volume"] == 2 and s.raw_missing_value_counts["busy"] == 1
    assert (s.rows_after_hourly_aggregation, s.hourly_missing_counts["busy"]) == (3, 1)
    assert (t.rows_after_time_cleaning, t.invalid_time_rows_dropped, t.rows_after_hourly_aggregation, t.hourly_start) == (0, 1, 0, None)
    headers = spark.createDataFrame([("s", ["time", "busy"], [], ["x"])], "station_id string, available_columns array<string>, missing_columns array<string>, unexpected_columns array<string>")
    known = {r.station_id: r for r in hourly.quality_report(rows, headers).collect()}["s"]
    assert known.raw_missing_value_counts == {"busy": 1}


def test_safe_divide_and_calendar(spark):
    pairs = [(1.0, 0.0, 0.0), (None, 2.0, 0.0), (math.inf, 1.0, 0.0), (1.0, math.inf, 0.0), (3.0, 4.0, 0.75), (math.nan, 1.0, 0.0)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a double, b double").select(safe_divide(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.q for r in rows] == [q for _, _, q in pairs]
    times = spark.createDataFrame([(DAY + dt.timedelta(hours=6),), (DAY + dt.timedelta(days=5),)], "time timestamp_ntz")
    monday, saturday = times.withColumns(calendar(F.col("time"))).collect()
    assert (monday.hour, monday.day_of_week, monday.is_weekend, monday.hour_sin) == (6, 0, 0, 1.0) and abs(monday.hour_cos) < 1e-12
    assert (saturday.day_of_week, saturday.is_weekend) == (5, 1)


def test_split_ends(spark):
    expected = {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (1, 2), 4: (2, 3), 10: (7, 8), 90: (62, 66), 100: (70, 75), 720: (503, 539)}
    a, b = dataset.split_ends(F.col("n"), PrepConfig())
    rows = spark.createDataFrame([(n,) for n in expected], "n long").select("n", a.alias("a"), b.alias("b")).collect()
    assert {r.n: (r.a, r.b) for r in rows} == expected


def test_split_sizes_for_all_small_n(spark):
    a, b = dataset.split_ends(F.col("id"), PrepConfig())
    for r in spark.range(3, 3000).select("id", a.alias("a"), b.alias("b")).collect():
        assert 1 <= r.a < r.b < r.id and r.a == min(max(math.floor(r.id * 0.70), 1), r.id - 2)


def test_fill_stops_at_split_borders(spark):
    rows = spark.createDataFrame([("s", "train", 0, None), ("s", "train", 1, 1.0), ("s", "val", 2, None), ("s", "val", 3, 2.0)], "station_id string, split string, time int, busy double")
    assert [r.busy for r in dataset.impute(rows, ["busy"]).orderBy("time").collect()] == [1.0, 1.0, 2.0, 2.0]
    whole = rows.withColumn("split", F.lit("train"))
    assert [r.busy for r in dataset.impute(whole, ["busy"]).orderBy("time").collect()] == [1.0, 1.0, 1.0, 2.0]


def test_target_gap_is_bridged(spark):
    cfg = PrepConfig(window=1, horizon=1)
    rows = spark.createDataFrame([("s", "train", 0, 1.0), ("s", "train", 2, 3.0)], "station_id string, split string, time int, volume double")
    got = scoring.naive_predictions(rows.withColumn("time", F.timestamp_seconds("time").cast("timestamp_ntz")), cfg).collect()
    assert {(r.method_name, r.y_true, r.y_pred) for r in got} == {(scoring.LAST_VALUE, 3.0, 1.0), (scoring.SEASONAL, 3.0, 1.0)}


def test_a_feature_missing_in_a_whole_split_drops_it(spark):
    rows = hourly_rows(spark, range(20), busy=[1.0] * 15 + [None] * 5)
    kept = dataset.clean_splits(rows, PrepConfig(window=2)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in kept} == {"train": 14, "val": 1}


def test_chunk_and_multiplicity_by_brute_force(spark):
    """All small cases through the library's columns, against windows and chunks that are dealt one by one."""
    cases = [(n, w, h) for n in range(0, 14) for w in range(1, 6) for h in range(1, 4)]
    for window, horizon in {(w, h) for _, w, h in cases}:
        rows = spark.range(14).withColumn("n", F.explode(F.sequence(F.col("id") + 1, F.lit(14))))
        got = rows.select("n", "id", dataset.multiplicity(PrepConfig(window=window, horizon=horizon), F.col("id"), F.col("n")).alias("m")).collect()
        for r in got:
            starts = range(max(0, r.n - window - horizon + 1))
            assert r.m == sum(s <= r.id < s + window for s in starts), (r, window, horizon)
    for clients in (1, 2, 3, 5, 20):
        rows = spark.range(30).withColumn("n", F.explode(F.sequence(F.col("id") + 1, F.lit(30))))
        dealt = {}
        for r in rows.select("n", "id", layouts._chunk(F.col("id"), F.col("n"), clients).alias("c")).collect():
            dealt.setdefault(r.n, {})[r.id] = r.c
        for n, chunks in dealt.items():
            want = [c for c in range(clients) for _ in range(n // clients + (c < n % clients))]
            assert [chunks[i] for i in range(n)] == want, (n, clients)


@given(st.integers(0, 2**31), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_ratios_are_checked_together(seed, window):
    with pytest.raises(ValueError, match="window.*ratios.*scaler"):
        PrepConfig(seed=seed, window=-window, train_ratio=0.9, scaler="robust")


def test_multiplicity_column(spark):
    cfg = PrepConfig(window=2, horizon=1)
    rows = spark.range(5).select(dataset.multiplicity(cfg, F.col("id"), F.lit(5)).alias("m")).collect()
    assert [r.m for r in rows] == [1, 2, 2, 1, 0]


def test_scaler(spark):
    # Two rows with weights 1 and 3 in the train windows, one constant feature.
    cfg = PrepConfig(window=2, horizon=1)
    rows = spark.createDataFrame([("s", "train", i, float(x), 7.0, 1.0) for i, x in enumerate([0, 2, 2, 9, 9])], "station_id string, split string, time int, busy double, idle double, volume double")
    got = {r.feature: (r.center, r.scale) for r in dataset.fit_scaler(rows, ["busy", "idle"], cfg).collect()}
    values = [0, 2, 2, 2, 2, 9]
    mean = sum(values) / 6
    assert got["busy"] == pytest.approx((mean, math.sqrt(sum((v - mean) ** 2 for v in values) / 6)))
    assert got["idle"] == (7.0, 1.0)
    low = {r.feature: (r.center, r.scale) for r in dataset.fit_scaler(rows, ["busy", "idle"], PrepConfig(window=2, horizon=1, scaler="minmax")).collect()}
    assert low == {"busy": (0.0, 9.0), "idle": (7.0, 1.0)}
    scaled = dataset.apply_scaler(rows, got, ["busy", "idle"]).collect()
    assert {r.idle for r in scaled} == {0.0} and {r.volume for r in scaled} == {1.0}
    with pytest.raises(RuntimeError):
        dataset.require_scaler(dataset.fit_scaler(rows.filter("split = 'val'"), ["busy"], cfg))
    with pytest.raises(ValueError):
        PrepConfig(scaler="robust")


def test_windows_and_their_checks(spark):
    cfg = PrepConfig(window=3, horizon=2)
    rows = spark.createDataFrame([("s", "train", DAY + dt.timedelta(hours=i), float(i), float(10 * i)) for i in range(7)], "station_id string, split string, time timestamp_ntz, busy double, volume double")
    made = dataset.sliding_windows(rows, ["busy"], cfg)
    got = sorted((r.y, [x[0] for x in r.X]) for r in made.collect())
    assert got == [(40.0, [0, 1, 2]), (50.0, [1, 2, 3]), (60.0, [2, 3, 4])]
    assert dataset.window_violations(made, cfg, 1).count() == 0
    assert dataset.window_violations(made, cfg, 2).first().wrong_width == 3
    assert dataset.non_finite_windows(made.withColumn("y", F.lit(float("nan")))).first().windows == 3
    repartitioned = sorted((r.y, [x[0] for x in r.X]) for r in dataset.sliding_windows(rows.repartition(3), ["busy"], cfg).collect())
    assert repartitioned == got
    explained = dataset.sample_explained(rows, cfg, samples=2).collect()
    assert sorted((r.sample, r.step, r.value, r.role) for r in explained)[:4] == [(1, 0, 0.0, "history"), (1, 1, 10.0, "history"), (1, 2, 20.0, "history"), (1, 4, 40.0, "target")]
    assert {r.sample for r in explained} == {1, 2}


@pytest.mark.parametrize(("n", "k", "sizes"), [(7, 3, [3, 2, 2]), (2, 4, [1, 1, 0, 0]), (5, 1, [5])])
def test_iid_chunks(spark, n, k, sizes):
    rows = spark.createDataFrame([("val", f"s{i % 2}", DAY + dt.timedelta(hours=i)) for i in range(n)], "split string, station_id string, t timestamp_ntz")
    assigned = layouts.iid_assignment(rows, k, 1)
    assert sorted(r.position for r in assigned.collect()) == list(range(n))
    counts = layouts.client_counts(assigned, layouts.roster(spark, k)).filter("split = 'val'").orderBy("client_id").collect()
    assert [r.samples for r in counts] == sizes
    assert {(r.station_id, r.t, r.client_id) for r in layouts.iid_assignment(rows.repartition(3), k, 1).collect()} == {(r.station_id, r.t, r.client_id) for r in assigned.collect()}
    with pytest.raises(ValueError):
        layouts.iid_assignment(rows, 0, 1)


def test_client_summary_and_usable(spark):
    rows = spark.createDataFrame([("a", "train", "s", DAY), ("a", "val", "s", DAY), ("a", "test", "t", DAY), ("b", "train", "s", DAY)], "client_id string, split string, station_id string, t timestamp_ntz")
    got = {r.client_id: r for r in layouts.client_summary(rows).collect()}
    assert (got["a"].train_samples, got["a"].train_station_count, got["b"].val_samples, got["b"].val_min_t) == (1, 1, 0, None)
    assert [(r.client_id, r.trains) for r in layouts.usable_clients(layouts.client_summary(rows)).collect()] == [("a", True)]
    assert layouts.keep_usable(rows).count() == 3


def test_metrics(spark):
    cases = {"a": ([1, 2, 3], [1, 2, 4]), "b": ([2, 2], [2, 2]), "c": ([2, 2], [1, 2]), "d": ([1], [1])}
    rows = spark.createDataFrame([(k, float(y), float(p)) for k, (ys, ps) in cases.items() for y, p in zip(ys, ps)], "method_name string, y_true double, y_pred double")
    got = {r.method_name: r for r in scoring.regression_metrics(rows, ["method_name"]).collect()}
    assert (got["a"].rmse, got["a"].mae, got["a"].r2) == pytest.approx((0.577350, 0.333333, 0.5), abs=1e-6)
    assert (got["b"].r2, got["c"].r2) == (1.0, 0.0) and math.isnan(got["d"].r2)
    absent = scoring.regression_metrics(rows.withColumn("split", F.lit("train")), ["method_name", "split"], ["train", "val"]).filter("split = 'val'").first()
    assert absent.sample_count == 0 and math.isnan(absent.rmse)
    with pytest.raises(Exception, match="finite"):
        scoring.regression_metrics(rows.withColumn("y_pred", F.lit(float("inf"))), ["method_name"]).collect()


def test_history(spark):
    rows = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.5, 3.0])], "run string, epoch int, val_rmse double")
    stop = scoring.early_stop(rows, 2).first()
    assert (stop.stopped_at, stop.stopped_early) == (4, True)
    assert scoring.best_epoch(rows.filter("epoch <= 4")).first().best_epoch == 2
    assert scoring.early_stop(rows, 9).first().stopped_early is False
    with pytest.raises(Exception, match="finite"):
        scoring.best_epoch(rows.withColumn("val_rmse", F.lit(float("nan")))).collect()
    odd = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([None, math.nan, math.inf, 7.0, None, 6.0, 6.0])], "run string, epoch int, val_rmse double")
    assert tuple(scoring.best_epoch(odd).first()) == ("r", 6, 6.0)
    assert scoring.early_stop(odd, 3).first().stopped_at == 3 and scoring.early_stop(odd.filter("epoch > 3"), 2).first().stopped_early is False


def test_federated(spark):
    states = spark.createDataFrame([(1, "a", "w", 0, 0.0), (1, "b", "w", 0, 4.0), (1, "a", "k", 0, 7.0), (1, "b", "k", 0, 9.0)], "round int, client_id string, name string, idx long, value double")
    sizes = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 3, 2.0)], "round int, client_id string, n long, loss double")
    got = {r.name: r.value for r in federated.average_parameters(states, sizes, ["k"]).collect()}
    assert got == {"w": 3.0, "k": 7.0}
    loss = federated.loss_means(sizes).first()
    assert (loss.train_loss_mean, loss.train_loss_weighted) == (1.5, 1.75)
    traffic = federated.round_traffic(sizes, 1024 * 1024).first()
    assert (traffic.communication_upload_mb, traffic.communication_total_mb, traffic.communication_cumulative_mb) == (2.0, 4.0, 4.0)
    assert federated.run_traffic(3, 2, 10)["communication_total_bytes"] == 120
    with pytest.raises(Exception, match="positive"):
        federated.average_parameters(states, sizes.withColumn("n", F.lit(0).cast("long"))).collect()
    with pytest.raises(Exception, match="size"):
        federated.average_parameters(states, sizes.filter("client_id = 'a'")).collect()
    same = states.withColumn("value", F.lit(2.5))
    assert {r.value for r in federated.average_parameters(same, sizes).collect()} == {2.5}


def test_parameters_in_chunks(spark):
    """Chunks give what scalars give, in fewer rows; the clients of a chunk are added up in groups."""
    rows = [(r, f"c{c}", name, i, float((7 * r + 3 * c + i) % 11)) for r in (1, 2) for c in range(10) for name, size in (("w", 10), ("b", 3), ("k", 1)) for i in range(size)]
    states = spark.createDataFrame(rows, "round int, client_id string, name string, idx long, value double")
    sizes = spark.createDataFrame([(r, f"c{c}", c + 1, 0.0) for r in (1, 2) for c in range(10)], "round int, client_id string, n long, loss double")
    chunked = federated.chunk_parameters(states, 4)
    assert chunked.count() == 2 * 10 * (3 + 1 + 1)
    want = {(r.round, r.name, r.idx): pytest.approx(r.value) for r in federated.average_parameters(states, sizes, ["k"]).collect()}
    found = federated.average_chunks(chunked, sizes, ["k"]).collect()
    assert {(r.round, r.name, 4 * r.chunk + i): v for r in found for i, v in enumerate(r["values"])} == want
    with pytest.raises(Exception, match="length"):
        federated.average_chunks(chunked.withColumn("values", F.when(F.col("client_id") == "c3", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("values"))), sizes).collect()
    with pytest.raises(Exception, match="size"):
        federated.average_chunks(chunked, sizes.filter("client_id <> 'c1'")).collect()


def test_positions_have_no_task_for_a_split(spark):
    """Offsets by ranges of groups: windows over rows and groups go by group or range, and the rest is one row a range."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "train").otherwise("val").alias("split"), F.format_string("%05d", F.col("id") % 700).alias("g"), "id")
    got = layouts.global_positions(rows, "split", "g", ["id"]).collect()
    for split in ("train", "val"):
        own = sorted((r.g, r.id, r.position, r.split_rows) for r in got if r.split == split)
        assert [x[2] for x in own] == list(range(len(own))) and {x[3] for x in own} == {len(own)}


def test_contracts(spark):
    features = feature_columns([*VALUE_COLUMNS, "occupancy_rate", "fast_occupancy_rate", "slow_occupancy_rate", "hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos"])
    assert len(features) == 19
    contracts.check_task(contracts.task_settings(PrepConfig(), features))
    with pytest.raises(ValueError, match="window_size"):
        contracts.check_task(contracts.task_settings(PrepConfig(window=12), features))
    with pytest.raises(ValueError):
        contracts.check_features(features, features[:-1])
    samples = spark.createDataFrame([("train", "s")], "split string, station_id string")
    digest = results.universe(samples).first().station_digest
    expected = spark.createDataFrame([("train", 1, 1, digest), ("val", 2, 1, digest)], "split string, samples long, stations long, digest string")
    assert [r.split for r in contracts.sample_universe(samples, expected).collect()] == ["val"]
    # As many stations, but others.
    other = samples.withColumn("station_id", F.lit("t"))
    assert [r.split for r in contracts.sample_universe(other, expected.filter("split = 'train'")).collect()] == ["train"]
    contracts.check_stations(samples, other, digest)
    with pytest.raises(ValueError, match="'t'.*'s'"):
        contracts.check_stations(other, samples, digest)
    with pytest.raises(RuntimeError):
        contracts.require_rows(samples.limit(0), "rows")
    with pytest.raises(ValueError):
        PrepConfig(train_ratio=0.9)
    with pytest.raises(ValueError):
        PrepConfig(window=0)
    with pytest.raises(ValueError):
        PrepConfig(frequency="1 fortnight")
    contracts.check_stations(samples, samples)
    with pytest.raises(ValueError, match="lost|not there"):
        contracts.check_stations(samples.limit(0), samples)


def test_other_frequencies(spark):
    rows = raw(spark, [("s", "2024-01-01 00:05:00", "2", "1"), ("s", "2024-01-01 00:20:00", "4", "1"), ("s", "2024-01-01 01:10:00", "9", "5")])
    got = [(r.time.strftime("%H:%M"), r.volume) for r in hourly.hourly_table(rows, frequency="30 minutes").orderBy("time").collect()]
    assert got == [("00:00", 2.0), ("00:30", None), ("01:00", 5.0)]


def test_split_stats_follow_from_counts(spark):
    table = hourly_rows(spark, [1.0] * 8 + [None] * 2 + [1.0] * 20)
    clean, cfg = dataset.clean_splits(table, PrepConfig(window=2)), PrepConfig(window=2)
    got = dataset.split_stats(table, clean, cfg).first()
    split = {r.split: r["count"] for r in dataset.chronological_split(table, cfg).groupBy("split").count().collect()}
    assert {s: got[f"{s}_rows_raw"] for s in split} == split and got.train_rows_dropped == 2
    assert sum(got[f"{s}_rows_clean"] for s in split) == clean.count()


def test_imputation_grows_with_the_rows(spark):
    """Ten times the rows of one station take less than ten times the time: nothing looks at all later rows for each row."""
    import time

    def seconds(n):
        base = spark.range(n).select(F.lit("s").alias("station_id"), F.lit("train").alias("split"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(DAY).cast("timestamp_ntz")).alias("time"), F.when(F.col("id") % 7 == 3, F.col("id").cast("double")).alias("a"), F.when(F.col("id") > n - 2, 1.0).alias("b"))
        began = time.perf_counter()
        got = dataset.impute(base, ["a", "b"]).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
        assert got.b == n and got.a == sum(3 if i < 3 else i - (i - 3) % 7 for i in range(n))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 10 * seconds(8_000)
