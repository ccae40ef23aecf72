"""The four polled alerts as one streaming job.

The ledger decides what is new: each micro-batch is held against it, delivers the
rest and appends their keys. Events, messages and keys are stored under the id of
the streaming query and of the batch, so a batch that runs again replaces its own
output, and a stream started anew over the same output neither replaces nor repeats
what an earlier one sent. One stream at a time may write to an output folder.

Rows dated ahead of the clock wait in a quarantine, stored by the day they are due, and
are delivered by the first batch after that. A batch opens only the days between the last
release and now, and days that lie before are removed, so what a batch reads doesn't
depend on how much was ever quarantined. Rows without a time are delivered at once: they
can neither wait nor be late.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.alerts import (
    EVENT_COLUMNS,
    EVENT_SCHEMA,
    LEDGER,
    MESSAGE_SCHEMA,
    alert_events,
    notification,
    read_ledger,
    record,
)
from wardline.sources.files import Files

LATENESS = "3 hours"
MAX_AHEAD = "10 minutes"
KEY = ["alert_name", "event_key", "client_ip"]
BATCH = "run_id string, batch_id long"
TABLES = {
    "events": EVENT_SCHEMA, "quarantine": f"{EVENT_SCHEMA}, due_date date",
    "notifications": MESSAGE_SCHEMA,
}
#: The day under which the ledger's rows without a time are held against each other.
NO_DAY = "0001-01-01"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """New Parquet files below ``path`` as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def new_alert_events(
    login_history: DataFrame, query_history: DataFrame, lateness: str | None = LATENESS,
    max_ahead: str = MAX_AHEAD,
) -> DataFrame:
    """Alert events from streams of logins and queries, with ``ahead`` for those not yet due.

    With ``lateness`` an event may come that much later than the newest one and is
    given out once in that time. Without it no event is too late, and repeats are left
    to the ledger. Rows dated further ahead than ``max_ahead`` never move the watermark,
    as one of them would carry it past good data, and neither do rows without a time.
    Logins of one instant from two addresses share a key but are both reported.
    """
    events = alert_events(login_history, query_history).withColumn(
        "event_timestamp", F.col("event_timestamp").cast("timestamp")
    )
    limit = F.current_timestamp() + F.expr(f"INTERVAL {max_ahead}")
    due = events.filter(F.col("event_timestamp") <= limit)
    if lateness is not None:
        due = due.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark(KEY)
    other = events.filter(F.coalesce(F.col("event_timestamp") > limit, F.lit(True)))
    # The key of a login is made of its time; without one, user and address stand for it.
    untimed = F.md5(F.concat_ws("|", "user_name", F.lit("no time"), "client_ip"))
    other = other.withColumn("event_key", F.coalesce("event_key", untimed))
    return due.withColumn("ahead", F.lit(False)).unionByName(
        other.withColumn("ahead", F.col("event_timestamp").isNotNull())
    )


def read_alerts(spark: SparkSession, path: str, table: str = "events") -> DataFrame:
    """``events``, ``notifications`` or ``quarantine`` of all streams that wrote to ``path``."""
    return spark.read.schema(f"{TABLES[table]}, {BATCH}").parquet(f"{path}/{table}")


def _folders(table: str) -> list[str]:
    return [*(["due_date"] if table == "quarantine" else []), "run_id", "batch_id"]


def _prepare(spark: SparkSession, path: str) -> None:
    """Tables without rows, so that the first batch and readers find them."""
    for table, schema in TABLES.items():
        empty = spark.createDataFrame([], f"{schema}, {BATCH}")
        empty.write.mode("append").partitionBy(*_folders(table)).parquet(f"{path}/{table}")
    days = spark.createDataFrame([], LEDGER).write.mode("append")
    days.partitionBy("event_date", "run_id", "batch_id").parquet(f"{path}/ledger")


def _not_sent(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events of which the ledger has no row. Only the days of the events are read."""
    first, last, untimed = events.agg(
        F.min(F.to_date("event_timestamp")), F.max(F.to_date("event_timestamp")),
        F.count_if(F.col("event_timestamp").isNull()),
    ).first()
    days = F.lit(False)
    if first is not None:
        days = F.col("event_date").between(F.lit(first), F.lit(last))
    if untimed:
        days = F.coalesce(days, F.lit(False)) | F.col("event_date").isNull()
    no_day = F.lit(NO_DAY).cast("date")
    sent = ledger.filter(days).select(
        "alert_name", "event_key", F.col("address").alias("_address"),
        F.coalesce("event_date", no_day).alias("event_date"),
    )
    keyed = events.withColumn(
        "event_date", F.coalesce(F.to_date("event_timestamp"), no_day)
    ).withColumn("_address", F.coalesce("client_ip", F.lit("")))
    on = ["alert_name", "event_key", "_address", "event_date"]
    return keyed.join(sent, on, "left_anti").select(*EVENT_COLUMNS)


class _Releases:
    """Up to when the quarantine was released, kept in a small file that is replaced.

    The start of the last batch's release is kept as well, so that a batch that runs
    again releases the same rows, and rows before it can be removed.
    """

    NAME = "_released"

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)
        self.last = json.loads(self.files.read(self.NAME)) if self.files.exists(self.NAME) else None

    def since(self, run_id: str, batch_id: int) -> str | None:
        """Start of this batch's release; None before the first."""
        if self.last is None:
            return None
        again = (self.last["run_id"], self.last["batch_id"]) == (run_id, batch_id)
        return self.last["since"] if again else self.last["until"]

    def done(self, run_id: str, batch_id: int, since: str | None, until: str) -> None:
        mark = {"run_id": run_id, "batch_id": batch_id, "since": since, "until": until}
        self.files.replace(self.NAME, json.dumps(mark))
        for name in self.files.names("quarantine") if since else []:
            day = name.removeprefix("due_date=")
            # The day itself may still be read by this batch, if it runs again.
            if day != name and day < since[:10]:
                self.files.remove(f"quarantine/{name}")


def _waiting(spark: SparkSession, path: str, since: str | None, until: str) -> DataFrame:
    """Quarantined rows that fell due after ``since``, up to ``until``; other days aren't opened."""
    at, rows = F.col("event_timestamp"), read_alerts(spark, path, "quarantine")
    due = (F.col("due_date") <= F.lit(until[:10]).cast("date")) & (at <= F.lit(until).cast("timestamp"))
    if since is not None:
        due &= F.col("due_date") >= F.lit(since[:10]).cast("date")
        due &= at > F.lit(since).cast("timestamp")
    return rows.filter(due)


def _deliver(path: str):
    def write(rows: DataFrame, table: str, run_id: str, batch_id: int) -> None:
        target = f"{path}/{table}/run_id={run_id}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(target)

    def hold_back(rows: DataFrame, run_id: str, batch_id: int) -> None:
        stamped = rows.withColumns(
            {
                "due_date": F.to_date("event_timestamp"), "run_id": F.lit(run_id),
                "batch_id": F.lit(batch_id).cast("long"),
            }
        )
        (
            stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_folders("quarantine")).parquet(f"{path}/quarantine")
        )

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The id of the streaming query: kept in its checkpoint, new with a new one.
        run_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
        ledger = read_ledger(spark, f"{path}/ledger").filter(~own)
        releases = _Releases(spark, path)
        since = releases.since(run_id, batch_id)
        batch = batch.persist()
        early = batch.filter("ahead").select(*EVENT_COLUMNS).dropDuplicates(KEY)
        # The release ends before anything this batch holds back, however long it takes.
        first = F.min("event_timestamp")
        moment = F.least(F.current_timestamp(), first - F.expr("INTERVAL 1 MICROSECOND"))
        held, until = early.agg(F.count("*"), moment.cast("string")).first()
        waiting = _waiting(spark, path, since, until).filter(~own)
        due = batch.filter(~F.col("ahead")).select(*EVENT_COLUMNS)
        due = due.unionByName(waiting.select(*EVENT_COLUMNS)).dropDuplicates(KEY).persist()
        fresh = _not_sent(due, ledger).persist()
        try:
            # Most polls find nothing, and leave no files.
            if not fresh.isEmpty():
                write(fresh, "events", run_id, batch_id)
                write(notification(fresh), "notifications", run_id, batch_id)
                record(fresh, f"{path}/ledger", batch_id, run_id=run_id)
            # Last, as what is due was read from the same table.
            if held:
                hold_back(early, run_id, batch_id)
            releases.done(run_id, batch_id, since, until)
        finally:
            for cached in (fresh, due, batch):
                cached.unpersist()

    return deliver


def start_alert_stream(
    login_history: DataFrame, query_history: DataFrame, path: str, checkpoint: str,
    every: str | None = None, lateness: str | None = LATENESS, max_ahead: str = MAX_AHEAD,
) -> StreamingQuery:
    """Run the alerts every ``every`` (say "5 minutes"), or once over all that is there.

    A backfill over files in any order is run with ``lateness=None``. Nothing runs
    until this is called.
    """
    _prepare(login_history.sparkSession, path)
    writer = (
        new_alert_events(login_history, query_history, lateness, max_ahead)
        .writeStream.foreachBatch(_deliver(path))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
