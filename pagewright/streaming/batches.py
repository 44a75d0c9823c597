"""Arrivals as a stream (an extension): the batch rules unchanged, and windowed counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events by day and type; works on static and streaming frames alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    out = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n")


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process all there is and return the final state, which stands as a table in the shared folder ``path``; nothing of it is in the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/state")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``spark.checkpoint.dir``; beside the warehouse where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"
