"""Written tables: hourly rows, windows, scalers, predictions, metrics, metadata and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATION
from ..operators import layouts
from ..operators.federated import COMMUNICATION_SCHEMA
from ..operators.scoring import canonical, format_time, short_predictions
from .readings import STATION_FOLDER
from .scratch import delete_folder, folder_exists

#: Windows are about 2 kB each, so that a file stays near 1 GB.
WINDOWS_PER_FILE = 500_000

#: The folders of the copy by balanced clients.
CLIENT_FOLDER = "client_folder"

WINDOW_COLUMNS = ("scenario", "client_id", "split", STATION, "t", "X", "y")


def write_hourly(hourly: DataFrame, folder: str) -> None:
    """Parquet with a folder for each station. The rows lie together by station already, so each gets few files.

    Folders are named by a copy of the station: the value in a folder's name comes back as a number where it
    looks like one, and ``007`` and ``7`` would become one station.
    """
    hourly.withColumn(STATION_FOLDER, F.col(STATION)).write.mode("overwrite").partitionBy(STATION_FOLDER).parquet(folder)


def write_station_csv(table: DataFrame, folder: str, suffix: str = ".csv") -> None:
    """One CSV file ``<station><suffix>`` for each station in ``folder``, beside files that are there.

    Spark writes a folder for each station; its one file is then renamed. A station's rows pass through one
    task, as its file has to; stations must be text that can name a file.
    """
    spark, staged = table.sparkSession, f"{folder}/_staged"
    dealt = table.withColumn(STATION_FOLDER, F.col(STATION)).drop(STATION).repartition(STATION_FOLDER)
    options = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    dealt.write.mode("overwrite").options(**options).partitionBy(STATION_FOLDER).csv(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(staged)
    for row in names.select("path").toLocalIterator():
        station = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(row.path.rsplit("/", 2)[-2].split("=", 1)[1])
        target = path(path(folder), station + suffix)
        store.delete(target, False)
        store.rename(path(row.path), target)
    store.delete(path(staged), True)


def write_windows(windows: DataFrame, folder: str, per_file: int = WINDOWS_PER_FILE) -> None:
    """Copies of windows in folders by scenario, client and split, in place of what is there.

    For readers that want one folder a client; :func:`write_dataset` keeps one copy for all layouts. Rows are
    dealt by folder and, where a folder has more than ``per_file`` of them, by a salt too.
    """
    keys = ["scenario", "client_id", "split"]
    parts = windows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_file).cast("int").alias("_parts"))
    salted = windows.join(parts, keys).withColumn("_salt", F.pmod(F.xxhash64(STATION, "t"), F.col("_parts")))
    dealt = salted.repartition(*keys, "_salt").select(*windows.columns)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy(*keys).parquet(folder)


def write_samples(windows: DataFrame, folder: str) -> None:
    """The one copy of all windows, in place of what is there.

    Rows lie together by station and in order of time already, so they are written where they are: a station's
    rows are next to each other in few files, and their bounds let a reader of one station skip the rest.
    """
    windows.write.mode("overwrite").option("maxRecordsPerFile", WINDOWS_PER_FILE).partitionBy("split").parquet(f"{folder}/samples")


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/samples")


def write_assignment(assigned: DataFrame, folder: str) -> None:
    """Which balanced client each sample belongs to, in order of clients: keys only, no window."""
    delete_folder(assigned.sparkSession, f"{folder}/clients")  # a copy by earlier clients
    rows = assigned.repartitionByRange("client_id", "split", STATION).sortWithinPartitions("client_id", "split", STATION, "t")
    rows.write.mode("overwrite").parquet(f"{folder}/assignment")


def write_client_windows(spark: SparkSession, folder: str) -> None:
    """A copy of the samples in order of the balanced clients of :func:`write_assignment`, for readers of one client at a time.

    A client's samples are a random choice of all, so in the one copy they lie in every file. Here a client lies in one
    of a fixed number of folders, and there in few row groups next to each other: a reader's filter leaves all other
    files out. Ranges of rows are written, so a task's share does not depend on how clients and folders are filled.
    """
    assigned = spark.read.parquet(f"{folder}/assignment").drop("position")
    rows = read_samples(spark, folder).join(assigned, ["split", STATION, "t"]).withColumn(CLIENT_FOLDER, layouts.client_bucket(F.col("client_id")))
    order = [CLIENT_FOLDER, "client_id", "split", STATION, "t"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", WINDOWS_PER_FILE).partitionBy(CLIENT_FOLDER).parquet(f"{folder}/clients")


def _client_windows(spark: SparkSession, folder: str, client_id: str | None) -> DataFrame:
    """Windows with their balanced client: from the copy in order of clients where there is one, else by a join of keys."""
    if folder_exists(spark, f"{folder}/clients"):
        rows = spark.read.parquet(f"{folder}/clients")
        if client_id is not None:
            rows = rows.filter(F.col(CLIENT_FOLDER) == layouts.client_bucket(F.lit(client_id)))
        return rows.drop(CLIENT_FOLDER)
    return read_samples(spark, folder).join(_of(spark.read.parquet(f"{folder}/assignment"), client_id, None).drop("position"), ["split", STATION, "t"])


def read_windows(spark: SparkSession, folder: str, scenario: str, client_id: str | None = None, split: str | None = None) -> DataFrame:
    """Windows of a layout, or of one client or split of it, from the one copy; an error if there are none."""
    made = read_samples(spark, folder)
    if scenario == layouts.CENTRALIZED:
        rows = layouts.centralized(made)
    elif scenario == layouts.STATION_CLIENTS:
        own = made if client_id is None else made.filter(F.col(STATION) == client_id.removeprefix(layouts.CLIENT))
        rows = layouts.station_clients(own)
    elif scenario == layouts.IID:
        rows = _client_windows(spark, folder, client_id).withColumn("scenario", F.lit(layouts.IID))
    else:
        raise ValueError(f"no layout {scenario!r}")
    rows = _of(rows, client_id, split).select(*WINDOW_COLUMNS)
    if rows.isEmpty():
        raise RuntimeError(f"no windows of {scenario} {client_id or ''} {split or ''} in {folder}")
    return rows


def _of(rows: DataFrame, client_id: str | None, split: str | None) -> DataFrame:
    for column, value in (("client_id", client_id), ("split", split)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows


def write_scaler(scaler: DataFrame, folder: str) -> None:
    scaler.coalesce(1).write.mode("overwrite").parquet(folder)


def read_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_predictions(predictions: DataFrame, folder: str, short: bool = False, nanoseconds: bool = False) -> None:
    """CSV in canonical column order, or ``t, station_id, y_true, y_pred, method``."""
    rows = short_predictions(predictions) if short else canonical(predictions)
    rows.withColumn("t", format_time(F.col("t"), nanoseconds)).write.mode("overwrite").csv(folder, header=True)


def write_table(table: DataFrame, folder: str) -> None:
    """A small table (metrics, history, rounds, clients) as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(folder, header=True)


def write_stations(stations: DataFrame, folder: str) -> None:
    """The names of a dataset's stations, one row each."""
    stations.select(STATION).write.mode("overwrite").parquet(folder)


def write_communication_rounds(spark: SparkSession, folder: str, rounds: DataFrame | None = None) -> None:
    """Traffic of each round; a run without traffic gets the header alone."""
    write_table(spark.createDataFrame([], COMMUNICATION_SCHEMA) if rounds is None else rounds, folder)


def write_record(record: DataFrame, folder: str) -> None:
    """The one row of a run (metadata, results) as JSON; nulls are written, so that every key is there."""
    record.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_record(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)


def write_metadata(spark: SparkSession, metadata: dict, folder: str) -> None:
    """Run metadata as one JSON row."""
    row = spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(folder)


def read_metadata(spark: SparkSession, folder: str) -> dict:
    """The metadata of a run; an error if it is missing."""
    row = spark.read.text(folder, wholetext=True).first()
    if row is None:
        raise FileNotFoundError(f"no metadata in {folder}")
    return json.loads(row.value)


def write_report(report: DataFrame, folder: str) -> None:
    """A station report with maps and arrays, one JSON row a station."""
    report.write.mode("overwrite").json(folder)
