"""The jobs: raw files to hourly tables, to window datasets, to client tables, naive forecasts and federated round reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPLITS, STATION, PrepConfig, feature_columns
from ..functions.columns import calendar, occupancy
from ..operators import chunks, contracts, dataset, federated, hourly, layouts, results, scoring
from ..sources import tables
from ..sources.readings import read_hourly, read_station_files
from ..sources.scratch import materialized


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _features(table: DataFrame, cfg: PrepConfig) -> list[str]:
    return feature_columns([*table.columns, *occupancy(table.columns), *calendar(F.lit(None))], cfg.target)


def build_hourly(spark: SparkSession, raw_folder: str, out_folder: str, cfg: PrepConfig | None = None) -> dict:
    """Raw station files to the hourly table, the quality report and the rejected stations.

    The raw rows are read once: their hours are kept with what the report needs, and both are finished from there.
    """
    cfg = cfg or PrepConfig()
    raw, headers, rejected = read_station_files(spark, raw_folder)
    profiled = materialized(hourly.profile_hours(raw, cfg.frequency, cfg.time_formats))
    tables.write_hourly(hourly.fill_hours(hourly.hours_of(profiled), cfg.max_span_hours, cfg.frequency), f"{out_folder}/hourly")
    table = contracts.require_rows(read_hourly(spark, f"{out_folder}/hourly", cfg), "station has hourly rows")
    report = materialized(hourly.station_report(profiled, headers, cfg.frequency))
    tables.write_report(report, f"{out_folder}/quality")
    tables.write_report(hourly.skipped_stations(report), f"{out_folder}/skipped")
    tables.write_report(rejected, f"{out_folder}/rejected")
    discovered = headers.count() + rejected.count()
    counters = hourly.run_counters(table, discovered).first().asDict()
    tables.write_metadata(spark, counters, f"{out_folder}/metadata")
    return counters


def build_datasets(spark: SparkSession, hourly_folder: str, out_folder: str, cfg: PrepConfig | None = None, export: tuple[str, ...] = (), by_client: bool = True) -> dict:
    """The hourly table to scaled windows for three layouts, the scaler, split statistics, client counts and metadata.

    The complete rows of all splits are made once and kept, long stations in chunks, and what follows reads them; windows are written once,
    and, unless ``by_client`` says no, once more in order of the balanced clients, so that a client can be read without
    the others. ``export`` names layouts to copy into a folder for each
    client too. A second run replaces the first.
    """
    cfg = cfg or PrepConfig()
    table = read_hourly(spark, hourly_folder, cfg)
    features = _features(table, cfg)
    clean = chunks.complete_rows(table, cfg)
    stats = materialized(dataset.split_stats(table, clean, cfg))
    tables.write_report(stats, f"{out_folder}/split_stats")
    valid = dataset.keep_valid(clean, cfg)
    tables.write_scaler(dataset.fit_scaler(valid, features, cfg), f"{out_folder}/scaler")
    known = dataset.require_scaler(tables.read_scaler(spark, f"{out_folder}/scaler"))
    scaled = chunks.overlapping(dataset.apply_scaler(valid, known, features), cfg)
    tables.write_samples(dataset.sliding_windows(scaled, features, cfg, (*dataset.SERIES, "block")), f"{out_folder}/windows")
    made = tables.read_samples(spark, f"{out_folder}/windows")
    bad = dataset.non_finite_windows(made).limit(5).collect()
    if bad:
        raise ValueError(f"windows that are not finite: {[(r[STATION], r['split']) for r in bad]}")
    stations = stats.filter("train_windows > 0").select(STATION)
    tables.write_stations(stations, f"{out_folder}/stations")
    clients = cfg.iid_clients or stations.count()
    keys = made.select("split", STATION, "t")
    tables.write_assignment(layouts.iid_assignment(keys, clients, cfg.seed), f"{out_folder}/windows")
    if by_client:
        tables.write_client_windows(spark, f"{out_folder}/windows")
    assigned = spark.read.parquet(f"{out_folder}/windows/assignment")
    tables.write_table(layouts.layout_counts(keys, assigned, layouts.roster(spark, clients)), f"{out_folder}/client_counts")
    if export:
        copies = [tables.read_windows(spark, f"{out_folder}/windows", scenario) for scenario in export]
        tables.write_windows(dataset.align_columns(copies), f"{out_folder}/export")
    outputs = {name: f"{out_folder}/{name}" for name in ("windows", "scaler", "split_stats", "client_counts", "stations")}
    tables.write_record(results.experiment_metadata(keys, stations, features, clients, cfg, _now(), outputs), f"{out_folder}/metadata")
    return tables.read_metadata(spark, f"{out_folder}/metadata")


def check_universe(clean: DataFrame, predictions: DataFrame, features: list[str], cfg: PrepConfig, metadata: dict) -> None:
    """An error where features, stations or samples are not those of a dataset's ``metadata``.

    Stations are compared by digest; only where it differs are names read from the dataset's table, and some told.
    """
    contracts.check_features(features, metadata["features"])
    expected = clean.sparkSession.read.parquet(metadata["outputs"]["stations"])
    contracts.check_stations(dataset.valid_stations(clean, cfg), expected, metadata["station_digest"])
    one = predictions.filter(F.col("method_name") == scoring.LAST_VALUE)
    counts = results.sample_counts(one).first().samples.asDict()
    if counts != metadata["samples"]:
        raise ValueError(f"samples {counts} are not those of the dataset, {metadata['samples']}")


def score_baselines(spark: SparkSession, hourly_folder: str, out_folder: str, cfg: PrepConfig | None = None, metadata: dict | None = None, run_name: str = "baseline") -> DataFrame:
    """Naive forecasts of the hourly table: test predictions, metrics by method and split, and a results row a method.

    With the ``metadata`` of a dataset run, its task, features, stations and sample counts are checked first. A
    split without any prediction is an error.
    """
    cfg = cfg or PrepConfig()
    if metadata is not None:
        contracts.check_task(metadata)
    table = read_hourly(spark, hourly_folder, cfg)
    clean = dataset.keep_valid(chunks.complete_rows(table, cfg), cfg)
    predictions = scoring.naive_predictions(chunks.overlapping(clean, cfg), cfg, (*dataset.SERIES, "block"))
    if metadata is not None:
        check_universe(clean, predictions, _features(table, cfg), cfg, metadata)
    metrics = materialized(scoring.regression_metrics(predictions, ["method_name", "split"], list(SPLITS)))
    empty = [r.split for r in metrics.filter("sample_count = 0").select("split").distinct().collect()]
    if empty or metrics.isEmpty():
        raise RuntimeError(f"no prediction in {sorted(empty) or 'any split'}")
    tables.write_predictions(predictions.filter(F.col("split") == "test"), f"{out_folder}/predictions")
    tables.write_table(metrics, f"{out_folder}/metrics")
    tables.write_communication_rounds(spark, f"{out_folder}/communication_rounds")
    stations, when = dataset.valid_stations(clean, cfg), _now()
    for method in (scoring.LAST_VALUE, scoring.SEASONAL):
        run = results.Run(run_name, "baseline", layouts.CENTRALIZED, method, when)
        tables.write_record(results.results_record(run, metrics.filter(F.col("method_name") == method), stations, cfg, {"hourly_folder": hourly_folder}), f"{out_folder}/results/{method}")
    return metrics


def score_predictions(
    spark: SparkSession,
    predictions: DataFrame,
    out_folder: str,
    run: results.Run,
    cfg: PrepConfig | None = None,
    *,
    training: results.Training = results.Training(),
    rounds: DataFrame | None = None,
    model_bytes: int = 0,
    folders: dict[str, str] | None = None,
    required: tuple[str, ...] = ("train", "val"),
) -> DataFrame:
    """A model's ``predictions(t, station_id, split, y_true, y_pred)`` to metrics by split, the short file of its test predictions, and its results row.

    Splits other than the ``required`` ones may be absent: their metrics are not numbers and count no sample, and the
    file of predictions may have its header alone. Predictions must be finite. ``training`` says how the model was
    trained, ``rounds`` (of :func:`chargeloom.operators.federated.communication_rounds`) what a federated run sent.
    """
    cfg = cfg or PrepConfig()
    named = scoring.with_errors(predictions.withColumn("method_name", F.lit(run.method)))
    metrics = materialized(scoring.regression_metrics(named, ["method_name", "split"], list(SPLITS)))
    absent = [r.split for r in metrics.filter("sample_count = 0").select("split").collect()]
    if metrics.isEmpty() or set(absent) & set(required):
        raise RuntimeError(f"no prediction in {sorted(absent) or 'any split'}")
    tables.write_predictions(named.filter(F.col("split") == "test"), f"{out_folder}/predictions", short=True)
    tables.write_table(metrics, f"{out_folder}/metrics")
    tables.write_communication_rounds(spark, f"{out_folder}/communication_rounds", rounds)
    stations = predictions.select(STATION).distinct()
    tables.write_record(results.results_record(run, metrics, stations, cfg, folders, training, rounds, model_bytes), f"{out_folder}/results/{run.method}")
    return metrics


def report_history(spark: SparkSession, history: DataFrame, patience: int, out_folder: str) -> DataFrame:
    """Training histories ``(run, epoch, ..., val_rmse)`` to the epochs up to where each run stops, and their summary, which is returned."""
    done, summary = scoring.training_summary(history, patience)
    tables.write_table(done.orderBy("run", "epoch"), f"{out_folder}/history")
    tables.write_table(summary.orderBy("run"), f"{out_folder}/summary")
    return summary


def load_clients(spark: SparkSession, dataset_folder: str, out_folder: str, scenario: str, official: dict | None = contracts.OFFICIAL_TASK) -> tuple[DataFrame, DataFrame]:
    """``(windows, summary)`` of the clients of a layout that a federated run can use; the summary is written too.

    The dataset's task must be the official one (or what ``official`` says; None checks nothing) and its windows
    sound. Of one-station clients those without val or test samples are left out; balanced ones stay, also empty.
    It is an error if no client is left, none has train samples, or none has val samples.
    """
    metadata = tables.read_metadata(spark, f"{dataset_folder}/metadata")
    if official is not None:
        contracts.check_task(metadata, official)
    windows = tables.read_windows(spark, f"{dataset_folder}/windows", scenario)
    task = PrepConfig(window=metadata["window_size"], horizon=metadata["horizon"])
    bad = dataset.window_violations(windows, task, metadata["feature_count"]).limit(5).collect()
    if bad:
        raise RuntimeError(f"windows of another shape, or not finite: {[(r[STATION], r['split']) for r in bad]}")
    roster = layouts.roster(spark, metadata["iid_clients"]) if scenario == layouts.IID else None
    summary = materialized(layouts.client_summary(windows.drop("X", "y"), roster))
    if scenario == layouts.STATION_CLIENTS:
        usable = layouts.usable_clients(summary).select("client_id")
        summary, windows = (t.join(usable, "client_id", "left_semi") for t in (summary, windows))
    seen = summary.agg(F.count(F.lit(1)).alias("clients"), F.count(F.when(F.col("train_samples") > 0, 1)).alias("training"), F.sum("val_samples").alias("val")).first()
    for found, what in ((seen.clients, "client can be used"), (seen.training, "client has train samples"), (seen.val, "client has val samples")):
        if not found:
            raise RuntimeError(f"no {what} in {dataset_folder}")
    tables.write_table(summary.orderBy("client_id"), f"{out_folder}/client_summary")
    return windows, summary


def report_rounds(
    spark: SparkSession,
    states: DataFrame,
    sizes: DataFrame,
    evaluation: DataFrame,
    model_bytes: int,
    out_folder: str,
    predictions: DataFrame | None = None,
    run: results.Run | None = None,
    cfg: PrepConfig | None = None,
    required: tuple[str, ...] = ("train", "val"),
) -> DataFrame:
    """Client states (scalars, or chunks with ``values``) and sizes to averaged parameters, round metrics and traffic; returns the best round.

    The best round and the run's total traffic are written too. With the ``predictions`` of the best model and the
    ``run`` that they are of, they are scored, and the results row has the rounds, the best one and the traffic.
    """
    chunked = "values" in states.columns
    (federated.average_chunks if chunked else federated.average_parameters)(states, sizes).write.mode("overwrite").parquet(f"{out_folder}/parameters")
    metrics = materialized(federated.round_metrics(sizes, evaluation, model_bytes))
    sent = materialized(federated.communication_rounds(sizes, model_bytes))
    tables.write_table(metrics, f"{out_folder}/round_metrics")
    tables.write_communication_rounds(spark, f"{out_folder}/communication_rounds", sent)
    best = materialized(scoring.best_epoch(metrics.withColumn("run", F.lit("federated" if run is None else run.name)), step="round"))
    tables.write_table(best, f"{out_folder}/best_round")
    seen = sent.agg(F.count(F.lit(1)).alias("rounds"), F.max("client_count").alias("clients")).first()
    tables.write_metadata(spark, {"rounds": seen.rounds, "clients": seen.clients or 0} | federated.run_traffic(seen.rounds, seen.clients or 0, model_bytes), f"{out_folder}/traffic")
    if predictions is not None and run is not None:
        # Every client trains one model, whose averaged parameters are counted in one round.
        first = states.agg(F.min("round")).first()[0]
        place, length = ("chunk", F.size("values")) if chunked else ("idx", F.lit(1))
        one = states.filter(F.col("round") == F.lit(first)).groupBy("name", place).agg(F.max(length).alias("size"))
        size = one.agg(F.sum("size")).first()[0] or 0
        training = results.Training(steps=seen.rounds, best_step=best.first().best_round, parameters=size)
        score_predictions(spark, predictions, f"{out_folder}/scores", run, cfg, training=training, rounds=sent, model_bytes=model_bytes, required=required)
    return best
