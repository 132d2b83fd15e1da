"""The folder that a session's driver and executors share, and results kept there while they are read again."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as the checkpoint folder of the session.

    On one machine a session without the setting gets a temporary folder. On a cluster that would lie where no
    executor can read it, so there the setting must be there.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        known = spark.conf.get("spark.checkpoint.dir", None)
        return known or context.getCheckpointDir().get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(found)
    return found


def materialized(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; what reads it again keeps its partitioning and does not compute it anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of finished shuffles, and checkpoints where it may, that nothing refers to any more.

    It does so when the driver's JVM happens to collect its garbage; a job of many short steps would pile them up until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder of any file system that Spark can reach is there."""
    store, path = _store(spark, folder)
    return store.exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark can reach."""
    store, path = _store(spark, folder)
    store.delete(path, True)
