"""Frames that are materialised in a folder which the driver and all executors share, so that their lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share.

    It comes from spark.checkpoint.dir; a temporary one is set only where none is configured and Spark runs in one process
    (tests). Raises ValueError on a cluster without the setting, as executors couldn't read a folder of the driver's.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kindred-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Nothing reads the shuffle files behind what is materialised in here, so Spark is asked to remove them then and not
    when the driver next collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def stored(df: DataFrame):
    """A frame as Parquet in the shared folder, for as long as the block lasts: for whole texts, which a checkpoint would
    hold uncompressed. What is made of it must be materialised before the block ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    try:
        with shuffles_removed(spark):
            df.write.parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        remove(spark, folder)
