"""Incremental molecule counts with Structured Streaming (an extension: the surveyed tool has no streams)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def count_molecules(events: DataFrame) -> DataFrame:
    """Running counts for each cell and barcode of a stream of events."""
    keys = F.col("user_id").alias("cell"), F.col("event_type").alias("intBC")
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and barcode; events of a later batch that are older than the watermark are left out.

    started: the minute at which the window starts. Events without a time are in no window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone: the session's
    counted = timed.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("intBC"))
    started = F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm").alias("started")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(started, "intBC", "n")


def event_stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    """The events files of a folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events*.parquet").schema
    return spark.readStream.schema(schema).options(**options).option("pathGlobFilter", "events*").parquet(sf_dir)


def drained(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of running counts n by keys, after the stream that they are of has been drained.

    A batch writes the counts that it changed, under its own number: a batch that is run again replaces what it wrote, and
    no batch writes old counts again. The last count of each key is taken when the table is read. A stream without rows
    has no counts; null keys are keys like others.
    """
    spark = counted.sparkSession
    folder = f"{_shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], counted.schema).write.parquet(f"{folder}/counts/batch=-1")
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
    stream = counted.writeStream.outputMode("update").foreachBatch(store)
    stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{folder}/counts")
    return written.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where the session names none."""
    set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (set_by_call.get() if set_by_call.isDefined() else "/tmp/checkpoints")
    return found.rstrip("/")


def drained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of each cell and barcode after the stream over the events has been drained."""
    return drained(count_molecules(event_stream(spark, sf_dir)), ["cell", "intBC"])


def drained_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of each window and barcode after the stream over the events has been drained."""
    return drained(windowed_counts(event_stream(spark, sf_dir)), ["started", "intBC"])
