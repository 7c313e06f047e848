"""Daily spend over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_spend(events: DataFrame, ts: str, key: str, value: str, settling_days: int = 2) -> DataFrame:
    """key, day, total, row_count per tumbling UTC day.

    On a stream in append mode a day is emitted once it is settled: when events ``settling_days``
    after its end have been seen. The state holds one row per key and open day.
    """
    return (
        events.withWatermark(ts, f"{settling_days} days")
        .groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("key"))
        .agg(F.sum(value).alias("total"), F.count("*").alias("row_count"))
        .select("key", F.col("w.start").cast("date").alias("day"), "total", "row_count")
    )
