"""Streams of events on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_in_flight(stream: DataFrame, keys: list[str], ts: str = "ts", wait: str = "30 seconds") -> DataFrame:
    """The first event of each key within the watermark; the others wait on it."""
    return stream.withWatermark(ts, wait).dropDuplicatesWithinWatermark(keys)


def telemetry(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Events with a hashed user id in place of the id."""
    return df.withColumn("user_hash", F.substring(F.sha2(F.col(user).cast("string"), 256), 1, 16)).drop(user)


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet files until the available input is used up; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
