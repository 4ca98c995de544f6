"""Reads from a growing folder: lines are parsed as in batch, counted by window, and pooled into the reads table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.reads import PARSERS


def stream_reads(spark: SparkSession, folder: str, kind: str, files_per_trigger: int = 64) -> DataFrame:
    return PARSERS[kind](spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def stream_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("chrom", "strand").agg(F.count("*").alias("n_reads"))


def pool_reads(reads: DataFrame, path: str, checkpoint: str, sample: str) -> StreamingQuery:
    """Append a stream of reads to the table that preprocess() writes; each micro-batch is committed once."""
    rows = reads.withColumn("sample", F.lit(sample))
    return rows.writeStream.format("parquet").partitionBy("sample", "chrom").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_events(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of timed signal values by window, late rows dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), F.col("event_type").alias("chrom"), "n", "total")
