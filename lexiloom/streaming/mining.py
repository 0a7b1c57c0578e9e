"""Log mining over a stream: tumbling windows with a watermark, and the batch operator's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(logs: DataFrame, window: str = "1 day", late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """start, query, volume, zero_results, clicks by window; rows later than `late` behind the newest are left out. Streams and tables alike."""
    at = F.col(time_col).cast("timestamp")
    grouped = logs.withColumn("__at", at).withWatermark("__at", late).groupBy(F.window("__at", window), "query")
    out = grouped.agg(F.count(F.lit(1)).alias("volume"), F.count_if(F.col("n_results") == 0).alias("zero_results"), F.count_if(F.col("clicked")).alias("clicks"))
    return out.select(F.col("window.start").alias("start"), "query", "volume", "zero_results", "clicks")


def start_mining(logs: DataFrame, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour", once: bool = False):
    """Closed windows appended as Parquet to `path`; exactly once through the checkpoint."""
    writer = windowed_counts(logs, window, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
