"""From raw documents to token ids: five stages, each one corpus operator whose decisions take effect.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read
again as the next stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeloom.llm import bpe, decontaminate, langid, quality, similar
from chargeloom.llm.common import checkpointed, fresh_folder, tables, unused_name, written
from chargeloom.sources.scratch import delete_folder, release

#: A text whose best language holds less than this (share of letters x posterior) is rejected.
MIN_LANGUAGE_SCORE = 0.3
#: Up to so many row keys are broadcast to drop their documents; beyond, the anti-join shuffles.
MAX_BROADCAST_IDS = 500_000

TOKENIZER = "word_bpe_49k.json"


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_row`` number of its own for each row, the same whenever it is read.

    Rows of Parquet files have their file and their place in it; any other table is written to the shared folder first.
    """
    files = docs.inputFiles()
    numbers = {zlib.crc32(f.encode()) for f in files}
    try:
        place = F.shiftleft(F.crc32(F.encode("_metadata.file_path", "UTF-8")), 31) + F.col("_metadata.row_index")
        keyed = docs.select("*", place.alias("_row"))
    except AnalysisException:  # no Parquet table
        keyed = None
    if keyed is None or not files or len(numbers) < len(files):
        return written(docs.withColumn("_row", F.monotonically_increasing_id()), fresh_folder(spark, "rows"))
    return keyed


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose ``_row`` is in ``gone(gone)``."""
    gone = checkpointed(gone.distinct())
    release(rows.sparkSession)
    few = gone.count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, rows["_row"] == gone["gone"], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their columns, whatever those are named.

    Every row is judged by its own text: a null or empty text as a text without words, a very long one whole,
    repeated rows alike. Rows without an id are judged like others; an empty table gives no rows.
    """
    model = quality.train(docs, tables(sf_dir)(spark, "labels"))
    return docs.filter(quality.scorer(model)(F.col("text")) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known with some certainty, with their columns, whatever those are named.

    A null or empty text, or one without a letter, has no language and goes. Every other row is judged by its whole
    text, repeated rows alike, rows without an id like others; an empty table gives no rows.
    """
    name = unused_name("language", docs)
    labelled = docs.withColumn(name, langid.labeller(langid.train(docs))(F.col("text")))
    return labelled.filter((F.col(name)["lang"] != langid.UNDETERMINED) & (F.col(name)["score"] >= MIN_LANGUAGE_SCORE)).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (:mod:`chargeloom.llm.similar`): the smallest id, then the smallest text.

    Rows are told apart by a row key, so what has no id is dealt with like any other (it is kept only where
    no copy has an id), and rows that share an id but are no near copies all stay. Texts without words are
    copies of each other; an empty table gives no rows; the columns stay as they are.
    """
    rows = _keyed(spark, docs)
    found = similar.near_copies(rows, id_col="_row")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "_row")
    best = rows.join(found, "_row").groupBy("component").agg(F.min(rank).alias("best")).select(F.col("best._row").alias("best"))
    gone = found.select("_row").join(best, found["_row"] == best["best"], "left_anti")
    return _without(rows, gone.select(F.col("_row").alias("gone"))).drop("_row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs.

    Rows are told apart by a row key: a contaminated row goes also when it has no id, and a clean row stays
    also when it shares its id with a contaminated one. A null or empty text holds no window; repeated rows go or
    stay together; an empty table gives no rows; the columns stay as they are.
    """
    rows = _keyed(spark, docs)
    found = decontaminate.decontaminate(rows.select("_row", "text"), tables(sf_dir)(spark, "benchmark"), id_col="_row")
    return _without(rows, found.filter("n_hit > 0").select(F.col("_row").alias("gone"))).drop("_row")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of each row: token ids and the text that they decode to.

    A null or empty text has no ids and decodes to the empty text; a very long one is coded whole; repeated rows
    each have a row, an empty table none.
    """
    path = public_tokenizers.path(TOKENIZER)
    return bpe.round_trip_documents(docs.select("doc_id", "text"), path, form="text").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL expresses none of the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last stays, as the result is read from it.
    """
    docs, before = tables(sf_dir)(spark, "documents"), None
    for _, stage in STAGES:
        folder = fresh_folder(spark, "pipeline")
        docs = written(stage(spark, docs, sf_dir), folder)
        if before is not None:
            delete_folder(spark, before)
        before = folder
    return docs
