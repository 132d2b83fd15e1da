"""Jobs from files to files, and the sources and sinks under them."""

import csv
import datetime as dt
import random

import pytest

from chargeloom.config import PrepConfig
from chargeloom.jobs import prepare
from chargeloom.operators import dataset, layouts, scoring
from chargeloom.sources import tables
from chargeloom.sources.readings import read_hourly, read_hourly_csv, read_station_files

HEADER = ["time", "busy", "idle", "s_price", "e_price", "fast_busy", "fast_idle", "slow_busy", "slow_idle", "duration", "volume"]


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("raw"), random.Random(1)
    for n, station in enumerate(("101", "102", "103")):
        header = HEADER if n else HEADER[::-1]
        rows = []
        for i in range(12 * 24 * 12):
            values = {c: rng.randrange(1, 9) for c in HEADER} | {"time": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i)).strftime("%Y-%m-%d %H:%M:%S")}
            rows.append([values[c] for c in header])
        write(folder / f"{station}.csv", header, rows)
    write(folder / "104.csv", ["busy", "volume"], [[1, 2]])
    write(folder / "105.csv", ["volume", "time", "extra"], [[3, "2024-01-01 00:05:00", "x"]])
    return str(folder)


def test_mixed_headers(spark, raw_folder):
    readings, headers, rejected = read_station_files(spark, raw_folder)
    assert [r.station_id for r in rejected.collect()] == ["104"]
    odd = readings.filter("station_id = '105'").first()
    assert (odd.volume, odd.busy, odd.time) == ("3", None, "2024-01-01 00:05:00") and "extra" not in readings.columns
    assert headers.filter("station_id = '105'").first().unexpected_columns == ["extra"]
    with pytest.raises(Exception):
        read_station_files(spark, raw_folder + "/none")


def test_all_jobs(spark, raw_folder, tmp_path):
    out = str(tmp_path)
    counters = prepare.build_hourly(spark, raw_folder, f"{out}/hours")
    assert counters == {"stations_discovered": 5, "stations_processed": 4, "hourly_rows": 3 * 288 + 1}
    assert tables.read_metadata(spark, f"{out}/hours/metadata") == counters
    cfg = PrepConfig(iid_clients=4, window=6)
    metadata = prepare.build_datasets(spark, f"{out}/hours/hourly", f"{out}/sets", cfg)
    assert metadata["stations"] == 3 and metadata["feature_count"] == 19
    n = metadata["samples"]
    assert n == {"train": 3 * (201 - 6), "val": 3 * (14 - 6), "test": 3 * (73 - 6)}
    for scenario in (layouts.CENTRALIZED, layouts.STATION_CLIENTS, layouts.IID):
        assert tables.read_windows(spark, f"{out}/sets/windows", scenario, split="train").count() == n["train"]
    one = tables.read_windows(spark, f"{out}/sets/windows", layouts.IID, "client_000")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(client_folder" in plan and "Join" not in plan
    assert len(one.inputFiles()) > len(one.select("_metadata.file_path").distinct().collect()) == 1
    assert one.filter("split = 'train'").count() in (n["train"] // 4, n["train"] // 4 + 1)
    assert len(one.first().X) == 6 and len(one.first().X[0]) == 19
    with pytest.raises(RuntimeError):
        tables.read_windows(spark, f"{out}/sets/windows", layouts.IID, "client_999")
    metrics = prepare.score_baselines(spark, f"{out}/hours/hourly", f"{out}/naive", cfg)
    assert {(r.method_name, r.split, r.sample_count) for r in metrics.collect()} == {(m, s, n[s]) for m in ("naive_last_value", "naive_seasonal_24h") for s in n}
    written = spark.read.csv(f"{out}/naive/predictions", header=True)
    assert written.columns == ["t", "station_id", "y_true", "y_pred", "error", "abs_error", "method_name"] and written.count() == 2 * n["test"]
    with pytest.raises(ValueError, match="window_size"):
        prepare.score_baselines(spark, f"{out}/hours/hourly", f"{out}/naive", cfg, metadata)


    again = prepare.build_datasets(spark, f"{out}/hours/hourly", f"{out}/sets", cfg, export=(layouts.CENTRALIZED, layouts.IID))
    assert {k: v for k, v in again.items() if k != "generated_at_utc"} == {k: v for k, v in metadata.items() if k != "generated_at_utc"}
    assert tables.read_windows(spark, f"{out}/sets/windows", layouts.CENTRALIZED).count() == sum(n.values())
    assert spark.read.parquet(f"{out}/sets/export").groupBy("scenario").count().count() == 2 and spark.read.parquet(f"{out}/sets/export").count() == 2 * sum(n.values())
    assert {r[0] for r in spark.read.parquet(metadata["outputs"]["stations"]).collect()} == {"101", "102", "103"} and "station_ids" not in metadata and metadata["split_ratios"] == {"train": 0.7, "val": 0.05, "test": 0.25}
    counts = spark.read.csv(f"{out}/sets/client_counts", header=True)
    assert counts.count() == 3 * (1 + 4 + 3) and counts.agg({"samples": "sum"}).first()[0] == 3 * sum(n.values())
    own = {"window_size": 6, "horizon": 1, "target_column": "volume", "feature_count": 19}
    windows, summary = prepare.load_clients(spark, f"{out}/sets", f"{out}/clients", layouts.STATION_CLIENTS, own)
    assert summary.count() == 3 and windows.count() == sum(n.values())
    assert spark.read.csv(f"{out}/clients/client_summary", header=True).count() == 3
    with pytest.raises(ValueError, match="window_size"):
        prepare.load_clients(spark, f"{out}/sets", f"{out}/clients", layouts.IID)
    paid = tables.read_record(spark, f"{out}/naive/results/naive_last_value").first()
    assert paid.run.method == "naive_last_value" and paid.data.samples.asDict() == n and paid.training.best_val_rmse == paid.metrics.val.rmse
    clean = dataset.keep_valid(dataset.clean_splits(read_hourly(spark, f"{out}/hours/hourly", cfg), cfg), cfg)
    forecasts = scoring.naive_predictions(clean, cfg)
    prepare.check_universe(clean, forecasts, metadata["features"], cfg, metadata)
    for wrong in ({"features": metadata["features"][1:]}, {"station_digest": "3-other"}, {"samples": n | {"val": 1}}):
        with pytest.raises(ValueError, match="differ|not those"):
            prepare.check_universe(clean, forecasts, metadata["features"], cfg, metadata | wrong)


def test_odd_station_names_and_values(spark, tmp_path):
    """Names stay text and whole, what only looks like a number is missing, and a second write replaces the first."""
    names = ["007", "7", "st 1", "a+b%20[c]", "ž"]
    rows = [(n, dt.datetime(2024, 1, 1, i), float("nan") if i == 1 else float(i)) for n in names for i in range(3)]
    table = spark.createDataFrame(rows, "station_id string, time timestamp_ntz, volume double")
    for _ in range(2):
        tables.write_hourly(table, f"{tmp_path}/h")
    got = {(r.station_id, r.time.hour): r.volume for r in read_hourly(spark, f"{tmp_path}/h", PrepConfig()).collect()}
    assert got == {(n, i): None if i == 1 else float(i) for n in names for i in range(3)}
    (tmp_path / "csv").mkdir()
    for n in names:
        write(tmp_path / f"csv/{n}_hourly.csv", ["time", "volume", "busy"], [["2024-01-01 00:00:00", v, v] for v in ("1d", "NaN", "0x1p3", "2")] + [["bad", 1, 1]])
    got = [(r.station_id, r.volume) for r in read_hourly_csv(spark, f"{tmp_path}/csv", PrepConfig()).collect()]
    assert sorted(got, key=str) == sorted([(n, v) for n in names for v in (None, None, None, 2.0)], key=str)
    folder = tmp_path / "raw"
    folder.mkdir()
    for n in names:
        write(folder / f"{n}.csv", ["\ufefftime", "volume", "volume"], [["2024-01-01 00:00:00", 1, 9]])
    (folder / "empty.csv").write_text("")
    readings, headers, rejected = read_station_files(spark, str(folder))
    assert sorted((r.station_id, r.volume) for r in readings.collect()) == sorted((n, "1") for n in names)
    assert {r.station_id for r in headers.collect()} == set(names) and [r.station_id for r in rejected.collect()] == ["empty"]
    tables.write_station_csv(table, f"{tmp_path}/named", "_hourly.csv")
    assert {r.station_id for r in read_hourly_csv(spark, f"{tmp_path}/named", PrepConfig()).collect()} == set(names)


def test_a_large_folder_of_windows_is_dealt_over_tasks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("centralized", "all", "train", "s", start + dt.timedelta(hours=i), [[1.0]], 1.0) for i in range(400)]
    made = spark.createDataFrame(rows, "scenario string, client_id string, split string, station_id string, t timestamp_ntz, X array<array<float>>, y float")
    for _ in range(2):
        tables.write_windows(made, f"{tmp_path}/w", per_file=50)
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/w").groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 50 and len(sizes) >= 8


def test_rounds_job(spark, tmp_path):
    states = spark.createDataFrame([(r, c, "w", 0, float(r)) for r in (1, 2) for c in "ab"], "round int, client_id string, name string, idx long, value double")
    sizes = spark.createDataFrame([(r, c, 2, 1.0) for r in (1, 2) for c in "ab"], "round int, client_id string, n long, loss double")
    evaluation = spark.createDataFrame([(1, 0.5), (2, 0.5)], "round int, val_rmse double")
    best = prepare.report_rounds(spark, states, sizes, evaluation, 10, str(tmp_path)).first()
    assert best.best_round == 1
    assert spark.read.parquet(f"{tmp_path}/parameters").count() == 2
    tables.write_communication_rounds(spark, f"{tmp_path}/none")
    assert spark.read.csv(f"{tmp_path}/none", header=True).columns[:2] == ["round", "client_count"]


def test_hourly_csv_and_missing_columns(spark, tmp_path):
    write(tmp_path / "a_hourly.csv", ["time", "volume", "busy"], [["2024-01-01 00:00:00", 1, 2]])
    write(tmp_path / "b_hourly.csv", ["time", "busy"], [["2024-01-01 00:00:00", 1]])
    write(tmp_path / "c_hourly.csv", ["busy", "volume", "time"], [[5, 6, "2024-01-01 01:00:00"]])
    rows = {r.station_id: (r.volume, r.busy) for r in read_hourly_csv(spark, str(tmp_path), PrepConfig()).collect()}
    assert rows == {"a": (1.0, 2.0), "c": (6.0, 5.0)}
    spark.range(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(RuntimeError):
        read_hourly(spark, f"{tmp_path}/other", PrepConfig())


def test_short_predictions_and_scaler_files(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "s", 1.0, 2.0, 1.0, 1.0, "m", "test")], "t timestamp_ntz, station_id string, y_true double, y_pred double, error double, abs_error double, method_name string, split string")
    tables.write_predictions(rows, f"{tmp_path}/p", short=True, nanoseconds=True)
    assert spark.read.csv(f"{tmp_path}/p", header=True).first().t == "2024-01-01T01:00:00.000000000"
    tables.write_predictions(rows, f"{tmp_path}/q")
    assert spark.read.csv(f"{tmp_path}/q", header=True).first().t == "2024-01-01 01:00:00"
    scaler = spark.createDataFrame([("busy", 1.0, 2.0)], "feature string, center double, scale double")
    tables.write_scaler(scaler, f"{tmp_path}/scaler")
    assert tables.read_scaler(spark, f"{tmp_path}/scaler").collect() == scaler.collect()
    assert layouts.first_k(rows, ["t"], 1).count() == 1
    assert layouts.merge_clients(rows, "val").count() == 0


def scans(plan: str) -> int:
    """File scans in the text of a plan."""
    return len({line.strip(" +-:*()0123456789") for line in plan.splitlines() if "FileScan" in line})


def test_many_headers_are_one_scan(spark, tmp_path):
    """A hundred headers over a thousand files: one scan, no union, columns by name."""
    from chargeloom.sources.readings import file_headers, read_by_name

    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(1000):
        k = n % 100
        names = [f"x{i}" for i in range(k % 10)] + (HEADER if k % 2 else HEADER[::-1])[: 11 - k // 10 % 3] + [f"y{k}"]
        write(folder / f"{n:04}.csv", names, [[f"{n}/{c}" for c in names]] * 2)
    headers = file_headers(spark, str(folder))
    assert headers.count() == 1000 and headers.select("header").distinct().count() == 100
    rows = read_by_name(spark, str(folder), headers)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert scans(plan) == 1 and "Union" not in plan
    got = rows.collect()
    assert len(got) == 2000
    for r in got:
        n, k = int(r.station_id), int(r.station_id) % 100
        there = (HEADER if k % 2 else HEADER[::-1])[: 11 - k // 10 % 3]
        assert all(r[c] == (f"{n}/{c}" if c in there else None) for c in HEADER), r


def test_raw_files_are_scanned_once(spark, raw_folder, tmp_path):
    """The report alone, and the table and the report together, read the raw lines once."""
    from chargeloom.operators import hourly
    from chargeloom.sources.scratch import materialized

    raw, headers, _ = read_station_files(spark, raw_folder)
    plan = hourly.quality_report(raw, headers)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan csv" in line for line in plan.splitlines()) == 1
    kept = materialized(hourly.profile_hours(raw))
    both = hourly.fill_hours(hourly.hours_of(kept)).unionByName(hourly.station_report(kept, headers).select("station_id"), allowMissingColumns=True)
    assert "FileScan csv" not in both._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in hourly.hourly_table(raw).collect()}
    assert {tuple(r) for r in hourly.fill_hours(hourly.hours_of(kept)).collect()} == want
