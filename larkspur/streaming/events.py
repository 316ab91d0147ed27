"""Structured Streaming over telemetry events: rate limits and counters in tumbling windows, resumable chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counters(events: DataFrame, ts: str = "ts", label: str = "event_type", value: str = "value", window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Count, mean and approximate percentiles of each label and tumbling window; the watermark lets go of old windows."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(label))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, [0.5, 0.95], 1000).alias("p")).select(F.col("w.start").alias("start"), label, "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def window_limits(events: DataFrame, key: str, limit: int, ts: str = "ts", window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Per key and tumbling window: requests, how many pass and how many are refused."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there and ends; with the same checkpoint, a later call goes on where this one stopped."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
