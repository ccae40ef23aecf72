"""Idle sessions from a stream of activity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.constants import IDLE_MINUTES


def idle_sessions_stream(
    activity: DataFrame, lateness: str = "3 hours", idle_minutes: Mapping[str, int] = IDLE_MINUTES
) -> DataFrame:
    """Closed sessions per user and session class, once the watermark passes them."""
    # As in the batch operator, a class that is not listed gets the strictest limit, and
    # an idle time equal to the limit does not end a session.
    gap = F.lit(_gap(min(idle_minutes.values())))
    for name, minutes in idle_minutes.items():
        gap = F.when(F.col("session_class") == name, _gap(minutes)).otherwise(gap)
    return (
        activity.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("user_name", "session_class", F.session_window("ts", gap).alias("session"))
        .agg(
            F.min("ts").alias("session_start"),
            F.max("ts").alias("session_end"),
            F.count("*").alias("events"),
        )
        .drop("session")
    )


def _gap(minutes: int) -> str:
    return f"{minutes} minutes 1 microsecond"
