"""What a run leaves beside its tables: one row of metadata, one row of results."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLITS, STATION, PrepConfig
from ..functions.columns import megabytes

METRICS = ("rmse", "mae", "r2", "mse")


@dataclass(frozen=True)
class Run:
    """What ran, and when: a method at a stage on one layout of the samples."""

    name: str
    stage: str
    layout: str
    method: str
    at: str


@dataclass(frozen=True)
class Training:
    """What a training did; a method without any has no steps."""

    steps: int = 0
    best_step: int | None = None
    stopped_early: bool = False
    parameters: int = 0


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value) if value is not None else F.lit(None).cast("string")


def _record(values: dict) -> Column:
    """A struct of literals (columns stand for themselves); None is a null text."""
    return F.struct(*(_literal(v).alias(k) for k, v in values.items()))


def _by_split(value) -> Column:
    return F.struct(*(value(s).alias(s) for s in SPLITS))


def digest(name: Column) -> Column:
    """An aggregate that tells sets of names apart without a list of them: their number, and a sum and an exclusive or of 60 bits of their MD5.

    It takes each name once, in any order, and its parts add up, so partial results are a few bytes.
    """
    bits = lambda at: F.conv(F.substring(F.md5(name), at, 15), 16, 10).cast("bigint")
    return F.concat_ws("-", F.count(name).cast("string"), F.hex(F.bit_xor(bits(1))), F.sum(bits(16).cast("decimal(38,0)")).cast("string"))


def universe(stations: DataFrame) -> DataFrame:
    """One row for a table with one row a station: ``stations`` (how many) and their ``station_digest``."""
    return stations.agg(F.count(F.lit(1)).alias("stations"), digest(F.col(STATION)).alias("station_digest"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """One row: samples of each split as a struct, zeros shown."""
    return samples.agg(_by_split(lambda s: F.count(F.when(F.col("split") == s, 1))).alias("samples"))


def experiment_metadata(samples: DataFrame, stations: DataFrame, features: list[str], clients: int, cfg: PrepConfig, generated_at: str, outputs: dict[str, str]) -> DataFrame:
    """One row that fixes a dataset: its task, splits, features, stations, samples and where its tables are.

    What has a row for each station or client, their names too, is in the tables that ``outputs`` names; the stations are
    fixed here by their digest.
    """
    settings = {
        "generated_at_utc": generated_at,
        "window_size": cfg.window,
        "horizon": cfg.horizon,
        "target_column": cfg.target,
        "split_ratios": _record(cfg.ratios),
        "seed": cfg.seed,
        "scaler": cfg.scaler,
        "iid_clients": clients,
        "features": F.array(*map(F.lit, features)),
        "feature_count": len(features),
        "outputs": _record(outputs),
    }
    both = universe(stations).join(sample_counts(samples))  # one row each
    return both.select(*(_literal(v).alias(k) for k, v in settings.items()), "stations", "station_digest", "samples")


def _traffic(rounds: DataFrame | None, model_bytes: int) -> DataFrame | None:
    """One row: what all rounds of a run sent, from :func:`chargeloom.operators.federated.communication_rounds`."""
    if rounds is None:
        return None
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sent = total("payload_bytes_total")
    return rounds.agg(
        F.struct(
            F.count(F.lit(1)).alias("rounds"), F.coalesce(F.max("client_count"), F.lit(0)).cast("long").alias("clients"), total("messages_up").alias("messages_up"), total("messages_down").alias("messages_down"),
            total("payload_bytes_up").alias("bytes_up"), total("payload_bytes_down").alias("bytes_down"), sent.alias("bytes"), megabytes(sent).alias("megabytes"), F.lit(model_bytes).cast("long").alias("model_bytes"),
        ).alias("traffic")
    )


_NO_TRAFFIC = {"rounds": 0, "messages_up": 0, "messages_down": 0, "bytes_up": 0, "bytes_down": 0, "bytes": 0, "model_bytes": 0}


def results_record(run: Run, metrics: DataFrame, stations: DataFrame, cfg: PrepConfig, folders: dict[str, str] | None = None, training: Training = Training(), rounds: DataFrame | None = None, model_bytes: int = 0) -> DataFrame:
    """One row of structs ``run, task, data, training, metrics, traffic`` for one method.

    ``metrics(split, rmse, mae, r2, mse, sample_count)`` has a row for each split; an absent one counts no samples, and a
    metric that is not a number is null. The best validation error is part of ``training``. ``rounds`` is the traffic
    of a federated run; without it every station counts as a client that sends nothing.
    """
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))))
    count = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("sample_count"))), F.lit(0)).cast("long")
    scores = metrics.agg(_by_split(lambda s: F.struct(*(at(s, c).alias(c) for c in METRICS), count(s).alias("sample_count"))).alias("metrics"), _by_split(count).alias("samples"))
    both = universe(stations).join(scores)  # one row each
    sent = _traffic(rounds, model_bytes)
    if sent is None:
        both = both.withColumn("traffic", F.struct(F.col("stations").alias("clients"), *(F.lit(v).cast("long").alias(k) for k, v in _NO_TRAFFIC.items()), F.lit(0.0).alias("megabytes")))
    else:
        both = both.join(sent)
    trained = {"trained": training.steps > 0, **asdict(training), "best_step": F.lit(training.best_step).cast("long"), "best_val_rmse": F.col("metrics.val.rmse")}
    data = {**(folders or {}), "stations": F.col("stations"), "station_digest": F.col("station_digest"), "samples": F.col("samples")}
    task = {"target": cfg.target, "window": cfg.window, "horizon": cfg.horizon}
    return both.select(_record(asdict(run)).alias("run"), _record(task).alias("task"), _record(data).alias("data"), _record(trained).alias("training"), "metrics", "traffic")
