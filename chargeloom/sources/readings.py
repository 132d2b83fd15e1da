"""Raw station files and hourly tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import STATION, TIME, VALUE_COLUMNS, PrepConfig
from ..functions.columns import number, parse_time
from .scratch import materialized

EXPECTED = (TIME, *VALUE_COLUMNS)

#: A header is looked for in so many bytes at the start of a file.
HEAD_BYTES = 1 << 16

#: The folders of a written hourly table are named by this copy of the station, so that the station itself stays text in the rows.
STATION_FOLDER = "station_folder"

#: Where a cloud store has several scheme names, the one that Arrow knows.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}

#: Headers of up to so many files are broadcast to the lines; beyond, the join shuffles.
MAX_BROADCAST_FILES = 200_000


def station_name(file: Column, suffix: str) -> Column:
    """The station of a file: its name without the suffix. Spark's names of files have escapes in them."""
    name = F.url_decode(F.replace(F.substring_index(file, "/", -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, re.escape(suffix) + "$", "")


def _same(file: Column) -> Column:
    """A file's name with one slash after the scheme: a listing and a scan write it with different numbers of them."""
    return F.regexp_replace(file, r"^([^:/]+):/+", "$1:/")


def _head(path: str) -> bytes:
    """The first bytes of a file."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        with open("/" + rest.lstrip("/"), "rb") as f:
            return f.read(HEAD_BYTES)
    store, inside = pafs.FileSystem.from_uri(quote(f"{_SCHEMES.get(scheme, scheme)}:{rest}", safe=":/"))
    with store.open_input_stream(inside) as f:
        return f.read(HEAD_BYTES)


def parse_header(head: bytes) -> tuple[str, ...]:
    """Column names in the first line of a CSV file; an empty file has none."""
    lines = head.decode("utf-8-sig", "replace").splitlines()
    return tuple(c.strip() for c in next(csv.reader(lines[:1]), ()))


def file_headers(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """``file``, ``station_id`` and ``header`` (an array of names) of each CSV file of a folder; an error if there is none.

    Tasks read the first bytes of each file, and the table of headers is kept in the shared folder. The driver has the
    files' names alone, which Spark's listing holds there for any scan (a scan itself has no row of an empty file).
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).inputFiles()
    if not listed:
        raise FileNotFoundError(f"no station files in {folder}")
    files = spark.createDataFrame([(p,) for p in listed], "file string")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = [list(parse_header(_head(unquote(p)))) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(headers, pa.list_(pa.string()))], names=["file", "header"])

    dealt = files.repartition(spark.sparkContext.defaultParallelism)
    return materialized(dealt.mapInArrow(emit, "file string, header array<string>").select(_same(F.col("file")).alias("file"), station_name(F.col("file"), suffix).alias(STATION), "header"))


def read_by_name(spark: SparkSession, folder: str, headers: DataFrame, suffix: str = ".csv") -> DataFrame:
    """The lines of the CSV files of a folder as ``station_id`` and the expected columns, all text, by any number of headers.

    One scan reads all files under as many unnamed columns as the longest header has; where a file has an expected
    column comes from its row of ``headers``. Files that are not in ``headers`` are left out. Of columns that
    share a name the first one counts; a column that a file does not have is null.
    """
    files, width = headers.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("header")), F.lit(0))).first()
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(max(1, width))])
    # With the schema enforced the first line of each file is skipped and not compared.
    lines = spark.read.csv(folder, schema=schema, header=True, enforceSchema=True, pathGlobFilter=f"*{suffix}")
    lines = lines.select(_same(F.col("_metadata.file_path")).alias("file"), F.array(*schema.names).alias("_fields"))
    places = headers.select("file", STATION, *(F.array_position("header", c).cast("int").alias(f"_{c}") for c in EXPECTED))
    placed = lines.join(F.broadcast(places) if files <= MAX_BROADCAST_FILES else places, "file")
    return placed.select(STATION, *(F.get("_fields", F.col(f"_{c}") - 1).alias(c) for c in EXPECTED))


def header_report(headers: DataFrame) -> DataFrame:
    """``station_id`` and, of its header, the expected columns that are there and missing, and the unexpected ones."""
    expected = F.array(*map(F.lit, EXPECTED))
    return headers.select(
        STATION,
        F.filter(expected, lambda c: F.array_contains("header", c)).alias("available_columns"),
        F.filter(expected, lambda c: ~F.array_contains("header", c)).alias("missing_columns"),
        F.filter("header", lambda c: ~F.array_contains(expected, c) & (c != STATION)).alias("unexpected_columns"),
    )


def read_station_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(readings, headers, rejected)`` of a folder of station CSV files.

    Readings are text under the expected columns, matched by name, with the file's stem as ``station_id``.
    ``headers`` has one row for each station: expected columns there and missing, and unexpected ones.
    ``rejected`` has the stations whose file has no time column; the others are read all the same.
    """
    headers = file_headers(spark, folder)
    timed = F.array_contains("header", TIME)
    usable = headers.filter(timed)
    if usable.isEmpty():
        raise RuntimeError(f"no station file of {folder} has a {TIME} column")
    rejected = headers.filter(~timed).select(STATION, F.lit(f"no {TIME} column").alias("reason"))
    return read_by_name(spark, folder, usable), header_report(usable), rejected


def _typed(table: DataFrame, station: Column, cfg: PrepConfig) -> DataFrame:
    """Station, time and the measurements that a table has, in their types; text is parsed as raw readings are."""
    types = {f.name: f.dataType for f in table.schema.fields}
    time = parse_time(F.col(TIME), cfg.time_formats) if isinstance(types[TIME], T.StringType) else F.col(TIME).cast("timestamp_ntz")
    values = [number(F.col(c), types[c]).alias(c) for c in VALUE_COLUMNS if c in types]
    return table.select(station.cast("string").alias(STATION), time.alias(TIME), *values).filter(F.col(TIME).isNotNull())


def read_hourly(spark: SparkSession, folder: str, cfg: PrepConfig) -> DataFrame:
    """A written hourly table (Parquet); an error without time or target.

    Stations stay the text that they were written as, not-a-number counts as missing, rows without a time go.
    """
    table = spark.read.parquet(folder)
    if not {TIME, cfg.target} <= set(table.columns):
        raise RuntimeError(f"{folder} has no {TIME} or no {cfg.target} column")
    return _typed(table, F.col(STATION), cfg)


def read_hourly_csv(spark: SparkSession, folder: str, cfg: PrepConfig) -> DataFrame:
    """Hourly CSV files named ``<station>_hourly.csv``; files without time or target are left out.

    Numbers and times are read by the rules for raw readings, so what is no number is missing. Measurements that no
    file has are no columns.
    """
    headers = file_headers(spark, folder, "_hourly.csv")
    usable = headers.filter(F.array_contains("header", TIME) & F.array_contains("header", cfg.target))
    known = usable.agg(*(F.coalesce(F.bool_or(F.array_contains("header", c)), F.lit(False)).alias(c) for c in VALUE_COLUMNS)).first()
    if not known[cfg.target]:
        raise RuntimeError(f"no usable hourly file in {folder}")
    rows = read_by_name(spark, folder, usable, "_hourly.csv")
    return _typed(rows.drop(*(c for c in VALUE_COLUMNS if not known[c])), F.col(STATION), cfg)
