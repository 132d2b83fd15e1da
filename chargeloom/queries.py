"""The registered queries of the station operators, each over the whole events table."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CALENDAR_COLUMNS, OCCUPANCY_COLUMNS, SPLITS, STATION, TIME, VALUE_COLUMNS, PrepConfig, feature_columns
from .jobs import prepare
from .operators import chunks, contracts, dataset, federated, hourly, layouts, results, scoring
from .sources import tables
from .sources.events import readings_from_events
from .sources.readings import read_hourly, read_hourly_csv, read_station_files
from .sources.scratch import delete_folder, materialized, shared_folder

CFG = PrepConfig()
FEATURES = feature_columns([*VALUE_COLUMNS, *OCCUPANCY_COLUMNS, *CALENDAR_COLUMNS], CFG.target)
IID_CLIENTS = 40
MODEL_BYTES = 308_740
PATIENCE = 3


def _num(name: str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero, so that a hash of the value is stable."""
    return (F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name)


def _text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def readings(spark: SparkSession, sf_dir: str, station: str = "event_type") -> DataFrame:
    return readings_from_events(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"), station)


def _hourly(spark: SparkSession, sf_dir: str, station: str = "event_type") -> DataFrame:
    return hourly.hourly_table(readings(spark, sf_dir, station))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.chronological_split(dataset.add_features(_hourly(spark, sf_dir)), CFG)


def _clean(spark: SparkSession, sf_dir: str, station: str = "event_type") -> DataFrame:
    return dataset.clean_splits(_hourly(spark, sf_dir, station), CFG)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.sliding_windows(dataset.keep_valid(_clean(spark, sf_dir), CFG), FEATURES, CFG)


def _keys(clean: DataFrame) -> DataFrame:
    """The keys of the windows of complete rows."""
    rows = dataset.with_position(dataset.keep_valid(clean, CFG))
    return rows.filter(F.col("rn") >= CFG.span).select(STATION, "split", F.col(TIME).alias("t"))


def _samples(spark: SparkSession, sf_dir: str, station: str = "event_type") -> DataFrame:
    """The windows' keys alone."""
    return _keys(_clean(spark, sf_dir, station))


def clean_readings(spark, sf_dir):
    return hourly.clean_readings(readings(spark, sf_dir)).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def duplicate_collapse(spark, sf_dir):
    return hourly.collapse_duplicates(hourly.clean_readings(readings(spark, sf_dir))).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS), "rows")


def hourly_rollup(spark, sf_dir):
    return _hourly(spark, sf_dir).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def hourly_rollup_users(spark, sf_dir):
    return _hourly(spark, sf_dir, "user_id").select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def quality_report(spark, sf_dir):
    found = hourly.quality_report(readings(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return found.select(
        STATION, "rows_before_cleaning", "rows_after_time_cleaning", "invalid_time_rows_dropped", "duplicate_timestamps_collapsed", "fully_missing_numeric_rows", "rows_after_hourly_aggregation",
        text("raw_missing_value_counts"), text("hourly_missing_counts"), _text("hourly_start"), _text("hourly_end"),
    )


def run_counters(spark, sf_dir):
    raw = readings(spark, sf_dir)
    discovered = raw.agg(F.countDistinct(STATION)).first()[0]
    return hourly.run_counters(hourly.hourly_table(raw), discovered)


def occupancy_features(spark, sf_dir):
    return dataset.add_features(_hourly(spark, sf_dir)).select(STATION, _text(TIME), *map(_num, OCCUPANCY_COLUMNS))


def calendar_features(spark, sf_dir):
    return dataset.add_features(_hourly(spark, sf_dir)).select(STATION, _text(TIME), *(F.col(c).cast("bigint").alias(c) for c in CALENDAR_COLUMNS[:3]), *map(_num, CALENDAR_COLUMNS[3:]))


def chronological_split(spark, sf_dir):
    return _split(spark, sf_dir).select(STATION, _text(TIME), "row_idx", "split")


def split_stats(spark, sf_dir):
    table = materialized(_hourly(spark, sf_dir))
    return dataset.split_stats(table, dataset.clean_splits(table, CFG), CFG)


def _imputed(spark, sf_dir, station):
    return _clean(spark, sf_dir, station).select(STATION, "split", _text(TIME), *(_num(c, 5) for c in [CFG.target, *FEATURES]))


def imputed_split(spark, sf_dir):
    return _imputed(spark, sf_dir, "event_type")


def imputed_split_users(spark, sf_dir):
    return _imputed(spark, sf_dir, "user_id")


#: Rows of a chunk in the queries on chunks: far fewer than a station has, so that each has many.
CHUNK = 90


def imputed_split_chunks(spark, sf_dir):
    """The rows of ``imputed_split_users``, by chunks."""
    return chunks.clean_splits(_hourly(spark, sf_dir, "user_id"), CFG, CHUNK).select(STATION, "split", _text(TIME), *(_num(c, 5) for c in [CFG.target, *FEATURES]))


def _blocks(spark, sf_dir, station="event_type"):
    rows = dataset.keep_valid(chunks.clean_splits(_hourly(spark, sf_dir, station), CFG, CHUNK), CFG)
    return chunks.overlapping(rows, CFG, CHUNK)


def sliding_windows_chunks(spark, sf_dir):
    """The rows of ``sliding_windows_long``, by overlapping blocks."""
    return _long_windows(dataset.sliding_windows(_blocks(spark, sf_dir), FEATURES, CFG, (*dataset.SERIES, "block")))


def baseline_metrics_chunks(spark, sf_dir):
    """The rows of ``baseline_metrics_users``, by overlapping blocks."""
    rows = scoring.naive_predictions(_blocks(spark, sf_dir, "user_id"), CFG, (*dataset.SERIES, "block"))
    return scoring.regression_metrics(rows, ["method_name", "split"]).select("method_name", "split", *map(_num, ("rmse", "mae", "r2", "mse")), "sample_count")


def scaler_chunks(spark, sf_dir):
    """The rows of ``scaler_standard_users``, by chunks."""
    rows = chunks.clean_splits(_hourly(spark, sf_dir, "user_id"), CFG, CHUNK)
    return dataset.fit_scaler(rows, FEATURES, CFG).select("feature", _num("center"), _num("scale"))


def valid_stations(spark, sf_dir):
    return dataset.valid_stations(_clean(spark, sf_dir), CFG)


def _scaler(spark, sf_dir, cfg, station="event_type"):
    return dataset.fit_scaler(materialized(_clean(spark, sf_dir, station)), FEATURES, cfg).select("feature", _num("center"), _num("scale"))


def scaler_standard(spark, sf_dir):
    return _scaler(spark, sf_dir, CFG)


def scaler_standard_users(spark, sf_dir):
    return _scaler(spark, sf_dir, CFG, "user_id")


def scaler_minmax(spark, sf_dir):
    return _scaler(spark, sf_dir, PrepConfig(scaler="minmax"))


def _scaled(spark, sf_dir, station):
    rows = materialized(dataset.keep_valid(_clean(spark, sf_dir, station), CFG))
    scaled = dataset.apply_scaler(rows, dataset.fit_scaler(rows, FEATURES, CFG), FEATURES)
    return scaled.select(STATION, "split", _text(TIME), *(_num(c, 4) for c in FEATURES), _num(CFG.target, 4))


def scaled_features(spark, sf_dir):
    return _scaled(spark, sf_dir, "event_type")


def scaled_features_users(spark, sf_dir):
    return _scaled(spark, sf_dir, "user_id")


def sliding_windows_long(spark, sf_dir):
    return _long_windows(_windows(spark, sf_dir))


def _long_windows(windows: DataFrame) -> DataFrame:
    long = windows.select(STATION, "split", _text("t"), _num("y", 5), F.posexplode("X").alias("step", "row"))
    return long.select(STATION, "split", "t", "y", F.col("step").cast("bigint").alias("step"), *((F.round(F.col("row")[i].cast("double"), 5) + F.lit(0.0)).alias(c) for i, c in enumerate(FEATURES)))


def window_violations(spark, sf_dir):
    """Windows against another contract than theirs, so that there is something to find."""
    return dataset.window_violations(_windows(spark, sf_dir), PrepConfig(window=23), len(FEATURES))


def non_finite_windows(spark, sf_dir):
    """Windows whose target is spoilt by rule: infinite where its hour is 5."""
    spoilt = F.when(F.hour("t") == 5, F.lit(float("inf")).cast("float")).otherwise(F.col("y"))
    return dataset.non_finite_windows(_windows(spark, sf_dir).withColumn("y", spoilt))


def sample_explained(spark, sf_dir):
    return dataset.sample_explained(_clean(spark, sf_dir), CFG).select(STATION, "sample", "step", _text(TIME), _num("value", 5), "role")


def naive_predictions(spark, sf_dir):
    found = scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir), CFG), CFG)
    return found.select(_text("t"), STATION, "split", *(_num(c, 5) for c in ("y_true", "y_pred", "error", "abs_error")), "method_name")


def _metrics(spark, sf_dir, keys, splits=None, station="event_type"):
    rows = scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir, station), CFG), CFG)
    return scoring.regression_metrics(rows, keys, splits).select(*keys, *map(_num, ("rmse", "mae", "r2", "mse")), "sample_count")


def baseline_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, ["method_name", "split"])


def baseline_metrics_users(spark, sf_dir):
    return _metrics(spark, sf_dir, ["method_name", "split"], station="user_id")


def station_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, ["method_name", "split", STATION])


def sample_universe_check(spark, sf_dir):
    """The samples against the counts that a split of all rows, complete or not, would give."""
    table = materialized(_hourly(spark, sf_dir))
    clean = materialized(dataset.clean_splits(table, CFG))
    stats = dataset.split_stats(table, clean, CFG)
    some = F.col("k.n") > 0
    kinds = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), dataset.window_count(F.col(f"{s}_rows_raw"), CFG).alias("n")) for s in SPLITS)))
    expected = stats.select(STATION, kinds.alias("k")).groupBy("k.split").agg(F.sum("k.n").alias("samples"), F.count(F.when(some, 1)).alias("stations"), results.digest(F.when(some, F.col(STATION))).alias("digest"))
    return contracts.sample_universe(_keys(clean), expected)


def centralized_counts(spark, sf_dir):
    return layouts.client_counts(layouts.centralized(_samples(spark, sf_dir)))


def non_iid_clients(spark, sf_dir):
    return layouts.station_clients(_samples(spark, sf_dir)).select("client_id", "scenario", STATION, "split", _text("t"))


def _iid(spark, sf_dir, station):
    # The keys are read twice, to count groups and to place rows in them.
    samples = materialized(_samples(spark, sf_dir, station))
    return layouts.iid_assignment(samples, IID_CLIENTS, CFG.seed).select("split", STATION, _text("t"), "position", "client_id")


def iid_clients(spark, sf_dir):
    return _iid(spark, sf_dir, "event_type")


def iid_clients_users(spark, sf_dir):
    return _iid(spark, sf_dir, "user_id")


def client_counts(spark, sf_dir):
    assigned = layouts.iid_assignment(_samples(spark, sf_dir), 1000, CFG.seed)
    return layouts.client_counts(assigned, layouts.roster(spark, 1000))


def _station_samples(spark, sf_dir):
    return layouts.station_clients(_samples(spark, sf_dir))


def client_summary(spark, sf_dir):
    found = layouts.client_summary(_station_samples(spark, sf_dir))
    return found.select("client_id", *(f"{s}_samples" for s in SPLITS), "train_station_count", *(_text(f"{s}_{m}_t") for s in SPLITS for m in ("min", "max")))


def usable_clients(spark, sf_dir):
    assigned = layouts.iid_assignment(_samples(spark, sf_dir), 60, CFG.seed)
    return layouts.usable_clients(layouts.client_summary(assigned))


def _rounds(spark, sf_dir) -> DataFrame:
    """Complete rows by day of the month as the round and station as the client."""
    return _clean(spark, sf_dir).withColumns({"round": F.dayofmonth(TIME), "client_id": F.col(STATION)})


def _sizes(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("round", "client_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(CFG.target).cast("double")).alias("loss"))


def client_sizes(spark, sf_dir) -> DataFrame:
    return _sizes(_rounds(spark, sf_dir))


def _states(rounds: DataFrame) -> DataFrame:
    """Means of the features as parameters of each round and client."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(0).cast("bigint").alias("idx"), F.col(c).alias("value")) for c in FEATURES)))
    means = rounds.groupBy("round", "client_id").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in FEATURES))
    return means.select("round", "client_id", pairs.alias("p")).select("round", "client_id", "p.*")


def fedavg_parameters(spark, sf_dir):
    rounds = materialized(_rounds(spark, sf_dir))
    return federated.average_parameters(_states(rounds), _sizes(rounds), ["is_weekend"]).select("round", "name", "idx", _num("value"))


def fedavg_chunks(spark, sf_dir):
    """The rows of ``fedavg_parameters``, from states in chunks of four: one vector of all features but the whole one."""
    rounds, kept = materialized(_rounds(spark, sf_dir)), "is_weekend"
    floats = [c for c in FEATURES if c != kept]
    place = F.array_position(F.array(*map(F.lit, floats)), F.col("name"))
    vector = _states(rounds).select("round", "client_id", F.when(place > 0, "floats").otherwise(kept).alias("name"), F.when(place > 0, place - 1).otherwise(F.lit(0)).alias("idx"), "value")
    found = federated.average_chunks(federated.chunk_parameters(vector, 4), _sizes(rounds), [kept])
    each = found.select("round", "name", "chunk", F.posexplode("values").alias("place", "value"))
    name = F.when(F.col("name") == kept, kept).otherwise(F.get(F.array(*map(F.lit, floats)), (F.col("chunk") * 4 + F.col("place")).cast("int")))
    return each.select("round", name.alias("name"), F.lit(0).cast("bigint").alias("idx"), _num("value"))


def client_loss_means(spark, sf_dir):
    return federated.loss_means(client_sizes(spark, sf_dir)).select("round", "client_count", _num("train_loss_mean"), _num("train_loss_weighted"))


def round_traffic(spark, sf_dir):
    found = federated.round_traffic(client_sizes(spark, sf_dir), MODEL_BYTES)
    return found.select("round", "client_count", *(_num(f"communication_{c}_mb") for c in ("upload", "download", "total", "cumulative")))


def communication_rounds(spark, sf_dir):
    return federated.communication_rounds(client_sizes(spark, sf_dir), MODEL_BYTES)


def _history(spark, sf_dir) -> DataFrame:
    """A history of each station: the day is the epoch, the root mean square of the volume (rounded) the value."""
    rows = _clean(spark, sf_dir).groupBy(F.col(STATION).alias("run"), F.dayofmonth(TIME).alias("epoch"))
    return rows.agg(F.round(F.sqrt(F.avg(F.pow(F.col(CFG.target).cast("double"), F.lit(2.0)))), 1).alias("val_rmse"))


def best_round(spark, sf_dir):
    return scoring.best_epoch(_history(spark, sf_dir)).select("run", "best_epoch", _num("best_val_rmse"))


def early_stop(spark, sf_dir):
    return scoring.early_stop(_history(spark, sf_dir), PATIENCE)


def align_columns(spark, sf_dir):
    """Two halves of the hourly table with different columns, under the union of both."""
    rows = hourly.rollup_hours(hourly.collapse_duplicates(hourly.clean_readings(readings(spark, sf_dir))))
    first = rows.filter(F.hour(TIME) < 12).select(STATION, TIME, "busy", "volume")
    second = rows.filter(F.hour(TIME) >= 12).select("volume", STATION, TIME, "idle")
    return dataset.align_columns([first, second]).select(STATION, _text(TIME), _num("busy"), _num("volume"), _num("idle"))


#: Stations named so that a file system, or a reader that guesses types, can go wrong on them.
FILE_STATIONS = {"click": "007", "view": "7", "error": "07", "signup": "st 1", "purchase": "a+b%20[c]"}


def _file_readings(spark, sf_dir) -> DataFrame:
    """Readings of stations with odd names, some volumes spoilt into what only looks like a number."""
    raw = readings(spark, sf_dir)
    name = F.create_map(*(F.lit(x) for pair in FILE_STATIONS.items() for x in pair))[F.col(STATION)]
    hour = F.substring(TIME, 12, 2)
    odd = F.when(hour == "03", F.lit("1d")).when(hour == "04", F.lit("NaN")).when(hour == "05", F.lit("0x1p3")).otherwise(F.col("volume"))
    return raw.withColumns({STATION: name, "volume": odd})


#: Folders that the query now running has made.
_made: list[str] = []


def _folder(spark, name: str) -> str:
    """A folder of a query's own below the shared one, deleted when its result is kept."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; if its result is read from folders that it made, the result is computed at once and they are deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _made.clear()
        found = query(spark, sf_dir)
        if _made:
            found = materialized(found)
            for folder in _made:
                delete_folder(spark, folder)
        return found

    return run


def station_files(spark, sf_dir):
    """Readings written as one CSV file a station under two headers, read back and cleaned."""
    folder, raw = _folder(spark, "stations"), materialized(_file_readings(spark, sf_dir))
    first = F.col(STATION).isin("007", "st 1")
    tables.write_station_csv(raw.filter(first).select(STATION, "volume", F.lit("x").alias("extra"), TIME, *(c for c in VALUE_COLUMNS if c not in ("volume", "e_price"))), folder)
    tables.write_station_csv(raw.filter(~first).select(STATION, TIME, *VALUE_COLUMNS), folder)
    read, _, _ = read_station_files(spark, folder)
    return hourly.clean_readings(read).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def hourly_files(spark, sf_dir):
    """The hourly table written twice and read back."""
    folder, table = _folder(spark, "hourly"), hourly.hourly_table(_file_readings(spark, sf_dir))
    for _ in range(2):
        tables.write_hourly(table, folder)
    return read_hourly(spark, folder, CFG).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def hourly_csv_files(spark, sf_dir):
    """The rolled-up hours as one CSV file a station, volumes spoilt by rule, read back as numbers."""
    folder = _folder(spark, "hourly-csv")
    rows = hourly.rollup_hours(hourly.collapse_duplicates(hourly.clean_readings(_file_readings(spark, sf_dir))))
    odd = F.when(F.hour(TIME) == 7, F.lit("1d")).when(F.hour(TIME) == 8, F.lit("NaN")).otherwise(F.col("volume").cast("string"))
    tables.write_station_csv(rows.withColumn("volume", odd), folder, "_hourly.csv")
    return read_hourly_csv(spark, folder, CFG).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def window_files(spark, sf_dir):
    """Windows written twice, once for all layouts, and read back by layout: first and last values of each."""
    folder, made = _folder(spark, "windows"), _windows(spark, sf_dir)
    for _ in range(2):
        tables.write_samples(made, folder)
    keys = tables.read_samples(spark, folder).select("split", STATION, "t")
    tables.write_assignment(layouts.iid_assignment(keys, IID_CLIENTS, CFG.seed), folder)
    rows = dataset.align_columns([tables.read_windows(spark, folder, s) for s in (layouts.CENTRALIZED, layouts.STATION_CLIENTS, layouts.IID)])
    tables.write_windows(rows, f"{folder}/export", per_file=1000)
    read = spark.read.parquet(f"{folder}/export").withColumns({"first": F.col("X")[0][0], "last": F.col("X")[CFG.window - 1][len(FEATURES) - 1]})
    return read.select("scenario", "client_id", "split", STATION, _text("t"), _num("y", 5), _num("first", 5), _num("last", 5))


def client_windows(spark, sf_dir):
    """The windows of some balanced clients, each read by itself from the copy in order of clients."""
    folder = _folder(spark, "clients")
    tables.write_samples(_windows(spark, sf_dir), folder)
    tables.write_assignment(layouts.iid_assignment(tables.read_samples(spark, folder).select("split", STATION, "t"), 300, CFG.seed), folder)
    tables.write_client_windows(spark, folder)
    read = dataset.align_columns([tables.read_windows(spark, folder, layouts.IID, f"client_{n:03}") for n in (0, 7, 256, 299)])
    return read.select("client_id", "split", STATION, _text("t"), _num("y", 5), (F.round(F.col("X")[0][0].cast("double"), 5) + F.lit(0.0)).alias("first"))


def client_job(spark, sf_dir):
    """The clients of one station each that a federated run can use, from a dataset's rows."""
    summary = layouts.client_summary(_station_samples(spark, sf_dir))
    kept = summary.join(layouts.usable_clients(summary).select("client_id"), "client_id", "left_semi")
    return kept.select("client_id", *(f"{s}_samples" for s in SPLITS), _text("train_min_t"), _text("test_max_t"))


def layout_counts(spark, sf_dir):
    samples = materialized(_samples(spark, sf_dir))
    assigned = layouts.iid_assignment(samples, IID_CLIENTS, CFG.seed)
    return layouts.layout_counts(samples, assigned, layouts.roster(spark, IID_CLIENTS))


def experiment_metadata(spark, sf_dir):
    """The metadata row of a dataset and its table of stations, both written and read back; the stations are listed in order."""
    folder, clean = _folder(spark, "metadata"), materialized(_clean(spark, sf_dir))
    stations, outputs = materialized(dataset.valid_stations(clean, CFG)), {"windows": "w", "stations": f"{folder}/stations"}
    tables.write_stations(stations, outputs["stations"])
    tables.write_record(results.experiment_metadata(_keys(clean), stations, FEATURES, IID_CLIENTS, CFG, "", outputs), f"{folder}/record")
    names = spark.read.parquet(outputs["stations"]).agg(F.array_join(F.array_sort(F.collect_list(STATION)), ",").alias("station_ids"))
    read = tables.read_record(spark, f"{folder}/record").join(names)  # one row each
    return read.select(
        "window_size", "horizon", "target_column", "seed", "scaler", "iid_clients", "feature_count", "stations", F.array_join("features", ",").alias("features"), "station_ids", "station_digest",
        *(F.col(f"samples.{s}").alias(f"{s}_samples") for s in SPLITS), *(F.col(f"split_ratios.{s}").alias(f"{s}_ratio") for s in SPLITS),
    )


def _run(method: str, stage: str = "baseline") -> results.Run:
    return results.Run("r", stage, layouts.CENTRALIZED, method, "")


def _by_split(records: DataFrame) -> DataFrame:
    """Results rows by split, each with the row's ``training`` and ``traffic``."""
    split = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"metrics.{s}").alias("m"), F.col(f"data.samples.{s}").alias("n")) for s in SPLITS))).alias("s")
    return records.select(F.col("run.method").alias("method_name"), "training", "traffic", split).select("method_name", "training", "traffic", "s.split", "s.m.*", F.col("s.n").alias("split_count"))


def results_payload(spark, sf_dir):
    """The results rows of both naive methods, written as JSON and read back, by split."""
    folder, clean = _folder(spark, "results"), materialized(dataset.keep_valid(_clean(spark, sf_dir), CFG))
    metrics = materialized(scoring.regression_metrics(scoring.naive_predictions(clean, CFG), ["method_name", "split"], list(SPLITS)))
    for method in (scoring.LAST_VALUE, scoring.SEASONAL):
        row = results.results_record(_run(method), metrics.filter(F.col("method_name") == method), dataset.valid_stations(clean, CFG), CFG)
        tables.write_record(row, f"{folder}/method={method}")
    rows = _by_split(tables.read_record(spark, folder)).select("*", "training.best_val_rmse", F.col("traffic.clients").alias("logical_client_count"), F.col("traffic.bytes").alias("payload_bytes_total"))
    return rows.select("method_name", "split", *map(_num, ("rmse", "mae", "r2", "best_val_rmse")), "sample_count", "split_count", "logical_client_count", "payload_bytes_total")


def _blend(spark, sf_dir) -> DataFrame:
    """Predictions as a trained model's: the mean of both naive forecasts of each sample."""
    rows = scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir), CFG), CFG)
    return rows.groupBy("t", STATION, "split", "y_true").agg(F.avg("y_pred").alias("y_pred"))


def scored_predictions(spark, sf_dir):
    """A prediction table scored by the job: metrics by split and what the results row says of the training."""
    folder, rows = _folder(spark, "scored"), materialized(_blend(spark, sf_dir))
    prepare.score_predictions(spark, rows, folder, _run("blend", "model"), CFG, training=results.Training(9, 4, True, 77), required=("train",))
    short = spark.read.csv(f"{folder}/predictions", header=True).agg(F.count(F.lit(1)).alias("test_rows"), F.max("method").alias("method"))
    found = _by_split(tables.read_record(spark, f"{folder}/results/blend"))
    return found.join(short).select("method", "split", *map(_num, ("rmse", "mae", "r2", "mse")), "sample_count", "test_rows", "training.steps", "training.best_step", "training.stopped_early", "training.parameters", "traffic.bytes")


def federated_results(spark, sf_dir):
    """A federated run's record: rounds, traffic, best round and the scores of its predictions."""
    folder, rounds = _folder(spark, "federated"), materialized(_rounds(spark, sf_dir))
    value = F.round(F.sqrt(F.avg(F.pow(F.col(CFG.target).cast("double"), F.lit(2.0)))), 1).alias("val_rmse")
    best = prepare.report_rounds(spark, _states(rounds), _sizes(rounds), rounds.groupBy("round").agg(value), MODEL_BYTES, folder, _blend(spark, sf_dir), _run("fedavg", "federated"), CFG, ("train",))
    found = _by_split(tables.read_record(spark, f"{folder}/scores/results/fedavg"))
    kept = ("rounds", "clients", "messages_up", "bytes_up", "bytes", "megabytes")
    rows = found.join(best.select("best_val_rmse")).select("split", "rmse", "sample_count", *(f"traffic.{c}" for c in kept), "training.best_step", "training.parameters", F.col("best_val_rmse").alias("best_round_rmse"))
    return rows.select("split", _num("rmse"), "sample_count", *kept[:-1], _num("megabytes"), "best_step", "parameters", _num("best_round_rmse"))


def run_history(spark, sf_dir):
    """Histories up to where they stop, written and read back, with their best and last steps."""
    folder = _folder(spark, "history")
    prepare.report_history(spark, _history(spark, sf_dir), PATIENCE, folder)
    done = spark.read.csv(f"{folder}/history", header=True, schema="run string, epoch bigint, val_rmse double")
    summary = spark.read.csv(f"{folder}/summary", header=True, schema="run string, best_epoch bigint, best_val_rmse double, stopped_at bigint, stopped_early boolean, steps bigint")
    return done.join(summary, "run").select("run", "epoch", _num("val_rmse"), "best_epoch", _num("best_val_rmse"), "stopped_at", "stopped_early", "steps")


def time_formats(spark, sf_dir):
    """Times in four forms by their hour: plain, with a T, with slashes, with a fraction."""
    raw, form = readings(spark, sf_dir), F.substring(TIME, 12, 2).try_cast("int") % 4
    odd = F.when(form == 1, F.replace(F.col(TIME), F.lit(" "), F.lit("T"))).when(form == 2, F.replace(F.col(TIME), F.lit("-"), F.lit("/"))).when(form == 3, F.concat(TIME, F.lit(".25")))
    return hourly.clean_readings(raw.withColumn(TIME, F.coalesce(odd, F.col(TIME))), CFG.time_formats).select(STATION, _text(TIME), *map(_num, VALUE_COLUMNS))


def scaler_files(spark, sf_dir):
    """The scaler written and read back."""
    folder = _folder(spark, "scaler")
    tables.write_scaler(dataset.fit_scaler(_clean(spark, sf_dir), FEATURES, CFG), folder)
    return tables.read_scaler(spark, folder).select("feature", _num("center"), _num("scale"))


def prediction_files(spark, sf_dir):
    """Test predictions written in both forms and read back."""
    folder, rows = _folder(spark, "predictions"), materialized(scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir), CFG), CFG).filter("split = 'test'"))
    tables.write_predictions(rows, f"{folder}/long")
    tables.write_predictions(rows, f"{folder}/short", short=True)
    long, short = (spark.read.csv(f"{folder}/{f}", header=True) for f in ("long", "short"))
    both = long.drop("error", "abs_error").withColumnRenamed("method_name", "method").withColumn("form", F.lit("long")).unionByName(short.withColumn("form", F.lit("short")))
    return both.select("form", "t", STATION, *(_num(c, 5) for c in ("y_true", "y_pred")), "method")


def metric_files(spark, sf_dir):
    """Metrics written as one table and read back."""
    folder = _folder(spark, "metrics")
    rows = scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir), CFG), CFG)
    tables.write_table(scoring.regression_metrics(rows, ["method_name", "split"]), folder)
    return spark.read.csv(folder, header=True).select("method_name", "split", *map(_num, ("rmse", "mae", "r2", "mse")), F.col("sample_count").cast("long").alias("sample_count"))


def round_files(spark, sf_dir):
    """Traffic of a run, and of one without any, written and read back."""
    folder, schema = _folder(spark, "rounds"), federated.COMMUNICATION_SCHEMA
    tables.write_communication_rounds(spark, f"{folder}/run", federated.communication_rounds(client_sizes(spark, sf_dir), MODEL_BYTES))
    tables.write_communication_rounds(spark, f"{folder}/none")
    return spark.read.csv([f"{folder}/run", f"{folder}/none"], header=True, schema=schema)


def skipped_stations(spark, sf_dir):
    """Stations of which no time is valid: those whose number 7 divides have theirs spoilt."""
    raw = readings(spark, sf_dir, "user_id")
    spoilt = raw.withColumn(TIME, F.when(F.col(STATION).cast("long") % 7 == 0, "never").otherwise(F.col(TIME)))
    return hourly.skipped_stations(hourly.quality_report(spoilt))


def task_violations(spark, sf_dir):
    """Settings of a dataset's metadata that another task does not support."""
    folder, clean = _folder(spark, "task"), materialized(_clean(spark, sf_dir))
    tables.write_record(results.experiment_metadata(_keys(clean), dataset.valid_stations(clean, CFG), FEATURES, IID_CLIENTS, CFG, "", {"windows": "w"}), folder)
    return contracts.task_violations(tables.read_record(spark, folder), contracts.OFFICIAL_TASK | {"window_size": 12, "stations": 3})


def first_rows(spark, sf_dir):
    """The first predictions by time, station and method."""
    rows = scoring.naive_predictions(dataset.keep_valid(_clean(spark, sf_dir), CFG), CFG)
    return layouts.first_k(rows, ["t", STATION, "method_name"], 500).select(_text("t"), STATION, "method_name", *(_num(c, 5) for c in ("y_true", "y_pred")))


NAMES = (
    "clean_readings duplicate_collapse hourly_rollup hourly_rollup_users quality_report run_counters occupancy_features calendar_features chronological_split split_stats imputed_split imputed_split_users valid_stations "
    "scaler_standard scaler_standard_users scaler_minmax scaled_features scaled_features_users sliding_windows_long window_violations non_finite_windows sample_explained naive_predictions baseline_metrics baseline_metrics_users "
    "station_metrics sample_universe_check centralized_counts non_iid_clients iid_clients iid_clients_users client_counts layout_counts client_summary usable_clients client_job fedavg_parameters client_loss_means round_traffic "
    "communication_rounds best_round early_stop align_columns station_files hourly_files hourly_csv_files window_files experiment_metadata results_payload "
    "scored_predictions federated_results run_history time_formats scaler_files prediction_files metric_files round_files skipped_stations task_violations first_rows "
    "imputed_split_chunks sliding_windows_chunks baseline_metrics_chunks scaler_chunks fedavg_chunks client_windows"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _tidy(globals()[name]) for name in NAMES}
