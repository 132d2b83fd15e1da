"""Tables of federated rounds: averaged parameters, losses and traffic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import megabytes

#: Client sizes of up to so many rows are broadcast; beyond, the join shuffles.
MAX_BROADCAST_ROWS = 1_000_000

#: Parameters in a chunk.
CHUNK = 4096

COMMUNICATION_SCHEMA = "round int, client_count bigint, messages_up bigint, messages_down bigint, payload_bytes_up bigint, payload_bytes_down bigint, payload_bytes_total bigint"


def _positive(n: Column) -> Column:
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("client sizes must be positive")).cast("bigint"))


def _with_sizes(states: DataFrame, sizes: DataFrame) -> DataFrame:
    """States with their client's size ``n``; a size that is not positive, or a client without one, fails the job."""
    few = sizes.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    known = sizes.select("round", "client_id", _positive(F.col("n")).alias("n"))
    joined = states.join(F.broadcast(known) if few else known, ["round", "client_id"], "left")
    return joined.withColumn("n", F.coalesce(F.col("n"), F.raise_error(F.lit("a client has no size")).cast("bigint")))


def average_parameters(states: DataFrame, sizes: DataFrame, integer_names: list[str] | None = None) -> DataFrame:
    """``round, name, idx, value``: the mean of the clients' parameters, weighted by their sizes.

    ``states(round, client_id, name, idx, value)``, ``sizes(round, client_id, n)``. Parameters named in
    ``integer_names`` are taken from the first client (by id). Sums are partial before they are shuffled by
    (round, name, idx). A size that is not positive, or a client without one, fails the job.
    """
    joined, n = _with_sizes(states, sizes), F.col("n")
    value = F.col("value").cast("double")
    first = F.min_by("value", "client_id").cast("double")
    mean = F.sum(value * n) / F.sum(n)
    out = F.when(F.col("name").isin(integer_names), first).otherwise(mean) if integer_names else mean
    return joined.groupBy("round", "name", "idx").agg(out.alias("value"))


def chunk_parameters(states: DataFrame, length: int = CHUNK) -> DataFrame:
    """Scalar states ``(round, client_id, name, idx, value)`` as chunks ``(round, client_id, name, chunk, values)``; indices of a name run from 0 without gaps."""
    placed = states.select("round", "client_id", "name", F.floor(F.col("idx") / length).alias("chunk"), F.struct("idx", F.col("value").cast("double").alias("value")).alias("v"))
    rows = placed.groupBy("round", "client_id", "name", "chunk").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return rows.select("round", "client_id", "name", "chunk", F.transform("v", lambda x: x["value"]).alias("values"))


def _added(lists: Column) -> Column:
    """Arrays of one length added up element by element; arrays of different lengths fail the job."""
    zero = F.transform(lists[0], lambda _: F.lit(0.0))
    add = lambda a, b: F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y)).otherwise(F.raise_error(F.lit("clients' parameters differ in length")).cast("array<double>"))
    return F.aggregate(lists, zero, add)


def average_chunks(states: DataFrame, sizes: DataFrame, integer_names: list[str] | None = None) -> DataFrame:
    """:func:`average_parameters` of parameters in chunks: ``states(round, client_id, name, chunk, values)`` to ``round, name, chunk, values``.

    A row is a chunk of a client's parameters, not one of them, so rows are fewer by the chunk's length. The clients
    of a chunk are added up in groups first, about as many as each has members, so that no task holds the chunks of more
    clients than the root of their number.
    """
    most = sizes.groupBy("round").count().agg(F.max("count")).first()[0] or 1
    groups = max(1, math.isqrt(most - 1) + 1)
    joined = _with_sizes(states, sizes).withColumn("_group", F.pmod(F.xxhash64("client_id"), F.lit(groups)))
    values = F.col("values").cast("array<double>")
    kept = F.col("name").isin(integer_names) if integer_names else F.lit(False)
    rows = joined.select("round", "name", "chunk", "_group", "n", F.when(~kept, F.transform(values, lambda v: v * F.col("n"))).alias("_sums"), F.when(kept, F.struct("client_id", values.alias("values"))).alias("_first"))

    def added(table: DataFrame, *keys: str) -> DataFrame:
        sums = table.groupBy("round", "name", "chunk", *keys).agg(F.sum("n").alias("n"), F.collect_list("_sums").alias("_sums"), F.min("_first").alias("_first"))
        return sums.withColumn("_sums", F.when(F.size("_sums") > 0, _added(F.col("_sums"))))

    total = added(added(rows, "_group"))
    return total.select("round", "name", "chunk", F.coalesce(F.col("_first.values"), F.transform("_sums", lambda v: v / F.col("n"))).alias("values"))


def loss_means(sizes: DataFrame) -> DataFrame:
    """Clients and the mean and size-weighted mean of their losses in each round."""
    return sizes.groupBy("round").agg(F.count(F.lit(1)).alias("client_count"), F.avg("loss").alias("train_loss_mean"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("train_loss_weighted"))


def communication_rounds(sizes: DataFrame, model_bytes: int) -> DataFrame:
    """Messages and bytes of each round: every client sends and gets the model once."""
    clients = F.col("client_count")
    one_way = clients * F.lit(model_bytes).cast("bigint")
    return sizes.groupBy("round").agg(F.count(F.lit(1)).alias("client_count")).select(
        "round", "client_count", clients.alias("messages_up"), clients.alias("messages_down"), one_way.alias("payload_bytes_up"), one_way.alias("payload_bytes_down"), (2 * one_way).alias("payload_bytes_total")
    )


def round_traffic(sizes: DataFrame, model_bytes: int) -> DataFrame:
    """Traffic of each round in megabytes, and up to it (a round's bytes times its number)."""
    rounds = communication_rounds(sizes, model_bytes)
    total = F.col("payload_bytes_total")
    return rounds.select(
        "round",
        "client_count",
        megabytes(F.col("payload_bytes_up")).alias("communication_upload_mb"),
        megabytes(F.col("payload_bytes_down")).alias("communication_download_mb"),
        megabytes(total).alias("communication_total_mb"),
        megabytes(total * F.col("round")).alias("communication_cumulative_mb"),
    )


def round_metrics(sizes: DataFrame, evaluation: DataFrame, model_bytes: int) -> DataFrame:
    """Losses, evaluation (``round, val_*``) and traffic of each round in one row."""
    return loss_means(sizes).join(evaluation, "round", "left").join(round_traffic(sizes, model_bytes).drop("client_count"), "round")


def run_traffic(rounds: int, clients: int, model_bytes: int) -> dict[str, float]:
    """Megabytes of a whole run with the same clients in every round."""
    total = 2 * model_bytes * clients * rounds
    return {"communication_total_bytes": total, "communication_total_mb": total / (1024 * 1024)}
