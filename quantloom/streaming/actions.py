"""Net rating actions over sliding event-time windows, with a watermark for late events. State is one counter for each
(symbol, window), dropped when the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_actions(events: DataFrame, ts: str, symbol: str, action: str, length: str = "6 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """(symbol, start, end, net, actions) of a streaming or batch frame."""
    rows = events.select(F.col(ts).cast("timestamp").alias("at"), F.col(symbol).alias("symbol"), F.col(action).alias("action"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    signed = F.when(F.col("action") == "upgrade", 1).when(F.col("action") == "downgrade", -1).otherwise(0)
    out = rows.groupBy("symbol", F.window("at", length, slide).alias("w")).agg(F.sum(signed).alias("net"), F.count("*").alias("actions"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "net", "actions")
