"""Pages as they arrive: the store as a stream, with failures retried and partial results kept. An extension; the same
operators run on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.extract import members
from kindred.sources.pages import PAGE


#: Bytes of files that a batch reads; pages are small files, so a bound on their number would make batches without end.
BATCH_BYTES = 64 << 20


def arriving(spark: SparkSession, folder: str, bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """Good pages, each address once a day of fetching; state older than two days is dropped."""
    pages = spark.readStream.schema(PAGE).option("maxBytesPerTrigger", bytes_per_trigger).option("recursiveFileLookup", "true").json(folder)
    pages = pages.where(F.col("status").between(200, 299)).withColumn("at", F.timestamp_seconds("fetched_at"))
    return pages.withWatermark("at", "2 days").dropDuplicatesWithinWatermark(["url"])


def keep_members(pages: DataFrame, folder: str, checkpoint: str):
    """Write (url, username) of members pages batch by batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        members(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type, for streams or batches."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
