"""Windowed counts over an event stream, with watermarks.

Money is never dropped for being late: sums of obligations are recomputed from
the table (a batch query), these windows are for readings and alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream, their column ``ts`` as event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, late: str, *keys: str) -> DataFrame:
    """Count and peak of each window and key."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


def sliding(events: DataFrame, length: str, every: str, late: str, *keys: str) -> DataFrame:
    """Count of each overlapping window and key."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, every), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    """Runs of events of a key that follow each other within ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def once(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """Each key at its first sighting only, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def alerts(events: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Readings at or above their key's threshold, with the share of it; ``thresholds`` is a static table (key, threshold)."""
    return events.join(thresholds, key).where(F.col("value") >= F.col("threshold")).withColumn("share", F.col("value") / F.col("threshold"))


def run_available(stream: DataFrame, checkpoint: str, table_path: str, mode: str = "append") -> None:
    """Process what is there, append results to a Parquet table and stop; the checkpoint makes it resumable."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", table_path).trigger(availableNow=True).start().awaitTermination()
