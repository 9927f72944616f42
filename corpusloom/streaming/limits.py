"""Fixed-window rate limits, on a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERMITS, WINDOW = 10, "1 minute"


def limited(events: DataFrame, permits: int = PERMITS, width: str = WINDOW) -> DataFrame:
    """event_id, user_id, start of the window, whether the event is among its client's first permits there."""
    start = F.window("ts", width)["start"]
    w = Window.partitionBy("user_id", "start").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", "ts", start.alias("start")).withColumn("allowed", F.row_number().over(w) <= permits).drop("ts")


def counted(stream: DataFrame, permits: int = PERMITS, width: str = WINDOW, late: str = "1 minute") -> DataFrame:
    """The same as a stream: per client and window, requests, allowed and refused ones; events later than
    the watermark are dropped by Structured Streaming."""
    n = F.count("*")
    per = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(n.alias("requests"))
    return per.select("user_id", F.col("w.start").alias("start"), "requests", F.least("requests", F.lit(permits)).alias("allowed"), F.greatest(F.col("requests") - permits, F.lit(0)).alias("refused"))
