"""The same classification over a stream of archives: counts by status and log type in event-time windows.

Mining needs a sorted, complete feed and stays with batches; ``foreachBatch`` is the place for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.operators.findings import classify
from tallylog.schema import DEFAULT_THRESHOLD
from tallylog.sources.archive import parse_events


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.option("lineSep", "\n").text(folder).where(F.col("value").rlike(r"[^\s]"))


def windowed_counts(lines: DataFrame, threshold: int = DEFAULT_THRESHOLD, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, observed_status, log_type, event_count. Events later than ``late`` behind the newest are left out."""
    rows = classify(parse_events(lines), threshold).withWatermark("event_timestamp", late)
    return rows.groupBy(F.window("event_timestamp", window).alias("w"), "observed_status", "log_type").agg(F.count(F.lit(1)).alias("event_count")).select(F.col("w.start").alias("window_start"), "observed_status", "log_type", "event_count")


def start_counts(lines: DataFrame, sink, checkpoint: str, threshold: int = DEFAULT_THRESHOLD) -> StreamingQuery:
    """Feed every micro-batch of updated counts to ``sink(batch, number)``."""
    return windowed_counts(lines, threshold).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
