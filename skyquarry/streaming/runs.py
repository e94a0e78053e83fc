"""Capture runs on a stream: session windows over event time, equal to the batch form once all input is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def runs(events: DataFrame, gap: str = "12 hours", watermark: str = "1 hour") -> DataFrame:
    """rig_id, n, first_utc, last_utc of each run; events: event_id, ts, user_id. A gap of exactly `gap` stays in one run."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withColumn("rig_id", (F.col("user_id") % 25).cast("int"))
    windowed = at.withWatermark("at", watermark).groupBy("rig_id", F.session_window("at", gap))
    return windowed.agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def run_to_end(spark: SparkSession, sf_dir: str, gap: str = "12 hours") -> DataFrame:
    """Runs the stream over what is there, in complete mode, and returns its last result."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id").schema
    name = f"runs_{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, sf_dir))
    job = runs(source, gap).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    job.awaitTermination()
    out = spark.table(name)
    return out.select("rig_id", "n", F.col("first_at").cast("timestamp_ntz").alias("first_utc"), F.col("last_at").cast("timestamp_ntz").alias("last_utc"))


def _stream_path(spark: SparkSession, sf_dir: str) -> str:
    """A streaming source lists folders: a single file is given as a glob of its own name."""
    return f"{sf_dir}/events.parque[t]"
