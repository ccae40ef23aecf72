"""Event histories at rest: Parquet by day, so a window reads only its days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import as_timestamp
from wardline.functions.clock import parse
from wardline.operators.evidence import digest
from wardline.sources.publish import publish

ROWS_PER_FILE = 20_000_000


def write_history(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Store a history by day. The adaptive plan gives a day as many tasks as its bytes need."""
    (
        df.withColumn("event_date", F.to_date(ts))
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", ts)
        .write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("event_date")
        .parquet(path)
    )


def read_history(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, since, until=None
) -> DataFrame:
    """Rows of a history from ``since`` up to ``until``; other days are not opened."""
    stored = T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])
    df = spark.read.schema(stored).parquet(path)
    first = F.lit(parse(since).date().isoformat()).cast("date")
    window = (F.col("event_date") >= first) & (F.col(ts) >= as_timestamp(df, ts, since))
    if until is not None:
        last = F.lit(parse(until).date().isoformat()).cast("date")
        window &= (F.col("event_date") <= last) & (F.col(ts) <= as_timestamp(df, ts, until))
    return df.filter(window).drop("event_date")


def month_bounds(period: str) -> tuple[dt.datetime, dt.datetime]:
    """First moment of month ``yyyy-MM`` and of the next."""
    first = dt.datetime.strptime(period, "%Y-%m")
    return first, (first + dt.timedelta(days=32)).replace(day=1)


def in_month(df: DataFrame, ts: str, period: str) -> DataFrame:
    first, after = month_bounds(period)
    return df.filter(
        (F.col(ts) >= as_timestamp(df, ts, first)) & (F.col(ts) < as_timestamp(df, ts, after))
    )


def history_digest(df: DataFrame, ts: str, name: str) -> DataFrame:
    """(history, event_date, row_count, sha256): one digest per day."""
    dated = df.withColumn("event_date", F.to_date(ts))
    return digest(dated, by=["event_date"]).select(
        F.lit(name).alias("history"), "event_date", "row_count", "sha256"
    )


def export_history(df: DataFrame, name: str, ts: str, period: str, path: str) -> DataFrame:
    """Copy a month of a history out and return the digests of the stored copy.

    The copy is published as a whole: an export that fails leaves the month as it was
    exported before. It is read back, so the digests vouch for what was written.
    """
    target = f"{path.rstrip('/')}/{name}/period={period}"
    month = in_month(df, ts, period).withColumn("event_date", F.to_date(ts))

    def by_day(rows: DataFrame, folder: str, _) -> None:
        write_history(rows.drop("event_date"), folder, ts, mode="errorifexists")

    copy = publish(month, target, ["event_date"], write=by_day).select(*df.columns)
    return publish(history_digest(copy, ts, name), f"{path.rstrip('/')}/_digests/{name}/period={period}")
