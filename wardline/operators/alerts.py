"""Polled security alerts: rules, late-data window, ledger and notifications.

The history tables fill late, so a poll looks back further than the worst
delay and drops what the ledger already holds, instead of reading on from the
last poll.

Events have alert_name, event_key, user_name, client_ip, query_text and
event_timestamp.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.constants import (
    ADMIN_ROLE,
    ADMIN_SKIPPED_TYPES,
    ALERT_ADMIN_QUERY,
    ALERT_BREAKGLASS,
    ALERT_MESSAGES,
    ALERT_POLICY_DETACH,
    ALERT_TAG_REMOVAL,
    BREAKGLASS_PATTERN,
    POLICY_DETACH_PATTERNS,
    TAG_UNSET_PATTERNS,
)
from wardline.functions import ago, as_timestamp, ilike_any
from wardline.functions.clock import parse

LOOKBACK_HOURS = 3
EVENT_COLUMNS = [
    "alert_name", "event_key", "user_name", "client_ip", "query_text", "event_timestamp",
]
EVENT_SCHEMA = (
    "alert_name string, event_key string, user_name string, client_ip string, query_text string, "
    "event_timestamp timestamp"
)
MESSAGE_SCHEMA = (
    "alert_name string, subject string, event_count long, message_no long, message_count long, "
    "body string"
)
LEDGER = (
    "alert_name string, event_key string, address string, notified_at timestamp_ntz, "
    "event_date date, run_id string, batch_id long"
)


def breakglass_events(login_history: DataFrame, pattern: str = BREAKGLASS_PATTERN) -> DataFrame:
    """Successful logins of an emergency account. The key is user and time only."""
    key = F.concat(F.col("user_name"), F.lit("|"), F.col("event_timestamp").cast("string"))
    return login_history.filter(
        F.col("user_name").ilike(pattern) & (F.col("is_success") == "YES")
    ).select(
        F.lit(ALERT_BREAKGLASS).alias("alert_name"),
        F.md5(key).alias("event_key"),
        "user_name",
        "client_ip",
        F.lit(None).cast("string").alias("query_text"),
        "event_timestamp",
    )


def statement_rules(
    detach: Iterable[str] = POLICY_DETACH_PATTERNS,
    untag: Iterable[str] = TAG_UNSET_PATTERNS,
    admin_role: str = ADMIN_ROLE,
    skip_types: Iterable[str] = ADMIN_SKIPPED_TYPES,
) -> dict[str, Column]:
    """Condition of each alert over successful statements."""
    text = F.col("query_text")
    return {
        ALERT_POLICY_DETACH: ilike_any(text, detach),
        ALERT_TAG_REMOVAL: ilike_any(text, untag),
        ALERT_ADMIN_QUERY: (F.col("role_name") == admin_role)
        & ~F.col("query_type").isin(*skip_types),
    }


def statement_events(
    query_history: DataFrame, rules: Mapping[str, Column] | None = None
) -> DataFrame:
    """Events of all statement rules from one pass over query history."""
    rules = statement_rules() if rules is None else rules
    names = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in rules.items()]))
    return (
        query_history.filter(F.col("execution_status") == "SUCCESS")
        .withColumn("alert_names", names)
        .filter(F.size("alert_names") > 0)
        .select(
            F.explode("alert_names").alias("alert_name"),
            F.col("query_id").alias("event_key"),
            "user_name",
            F.lit(None).cast("string").alias("client_ip"),
            "query_text",
            F.col("start_time").alias("event_timestamp"),
        )
    )


def policy_detach_events(
    query_history: DataFrame, patterns: Iterable[str] = POLICY_DETACH_PATTERNS
) -> DataFrame:
    """Statements that took a masking or row-access policy off an object."""
    rule = {ALERT_POLICY_DETACH: statement_rules(detach=patterns)[ALERT_POLICY_DETACH]}
    return statement_events(query_history, rule)


def tag_unset_events(
    query_history: DataFrame, patterns: Iterable[str] = TAG_UNSET_PATTERNS
) -> DataFrame:
    """Statements that took a classification tag, and with it the mask, off a column."""
    rule = {ALERT_TAG_REMOVAL: statement_rules(untag=patterns)[ALERT_TAG_REMOVAL]}
    return statement_events(query_history, rule)


def admin_session_events(
    query_history: DataFrame,
    role: str = ADMIN_ROLE,
    skip_types: Iterable[str] = ADMIN_SKIPPED_TYPES,
) -> DataFrame:
    """Statements run under the top administrative role, metadata commands aside."""
    rules = statement_rules(admin_role=role, skip_types=skip_types)
    return statement_events(query_history, {ALERT_ADMIN_QUERY: rules[ALERT_ADMIN_QUERY]})


def alert_events(login_history: DataFrame, query_history: DataFrame) -> DataFrame:
    """Events of all four alerts."""
    return breakglass_events(login_history).unionByName(statement_events(query_history))


def new_events(
    events: DataFrame, ledger: DataFrame, as_of, lookback_hours: float = LOOKBACK_HOURS
) -> DataFrame:
    """Events inside the look-back, none later than ``as_of``, that the ledger does not hold.

    Of a ledger stored by the day of its events (see ``record``) only the days of
    the look-back are read.
    """
    known = ledger
    if "event_date" in ledger.columns:
        first = parse(as_of) - dt.timedelta(hours=lookback_hours)
        known = ledger.filter(F.col("event_date") >= F.lit(first.date()))
    recent = events.filter(
        (F.col("event_timestamp") > ago(events, "event_timestamp", as_of, hours=lookback_hours))
        & (F.col("event_timestamp") <= as_timestamp(events, "event_timestamp", as_of))
    )
    return recent.join(
        known.select("alert_name", "event_key"), ["alert_name", "event_key"], "left_anti"
    )


def record(
    events: DataFrame, ledger_path: str, batch_id: int, notified_at=None, run_id: str = "poll"
) -> None:
    """Append the events' keys to the ledger, below the day of the event.

    A batch is known by ``run_id`` and ``batch_id``: one that runs again replaces its
    own keys, and no other run's.
    """
    stamp = parse(notified_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    (
        events.select(
            "alert_name", "event_key", F.coalesce("client_ip", F.lit("")).alias("address"),
            F.to_date("event_timestamp").alias("event_date"),
        )
        .distinct()
        .withColumn("notified_at", F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz"))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "run_id", "batch_id")
        .parquet(ledger_path)
    )


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The ledger that ``record`` appends to."""
    return spark.read.schema(LEDGER).parquet(ledger_path)


def _by_alert(values: Mapping[str, Column]) -> Column:
    chosen = F.lit(None).cast("string")
    for name, value in values.items():
        chosen = F.when(F.col("alert_name") == name, value).otherwise(chosen)
    return chosen


def event_line() -> Column:
    """The line of one event in a message."""
    user, time = F.col("user_name"), F.col("event_timestamp").cast("string")

    def line(actor: str, label: str, value: Column) -> Column:
        return F.concat(
            F.lit(f"{actor}: "), user, F.lit(f" | {label}: "), value, F.lit(" | Time: "), time
        )

    statement = line("Actor", "SQL", F.left("query_text", F.lit(200)))
    return _by_alert(
        {
            ALERT_BREAKGLASS: line("User", "IP", F.col("client_ip")),
            ALERT_POLICY_DETACH: statement,
            ALERT_TAG_REMOVAL: statement,
            ALERT_ADMIN_QUERY: line("User", "Query", F.left("query_text", F.lit(150))),
        }
    )


def notification(events: DataFrame, lines_per_message: int = 500) -> DataFrame:
    """(alert_name, subject, event_count, message_no, message_count, body).

    An alert with many events is spread over several messages of about
    ``lines_per_message`` lines, so no message outgrows a task. The lines of a
    message are sorted, and a repeated line is sent once with its number.
    """
    lines = (
        events.withColumn("line", event_line())
        .groupBy("alert_name", "line")
        .agg(F.count("*").alias("copies"))
    )
    # One row per alert rule, so its size does not grow with the events.
    totals = lines.groupBy("alert_name").agg(
        F.sum("copies").alias("event_count"),
        F.ceil(F.count("line") / lines_per_message).cast("bigint").alias("message_count"),
    )
    bucket = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")
    number = F.coalesce(bucket % F.greatest("message_count", F.lit(1)), F.lit(0)) + 1
    repeated = F.when(
        F.col("copies") > 1, F.concat(F.lit(" (x"), F.col("copies").cast("string"), F.lit(")"))
    ).otherwise("")
    subject = _by_alert({name: F.lit(s) for name, (s, _) in ALERT_MESSAGES.items()})
    opening = _by_alert({name: F.lit(o + "\n\n") for name, (_, o) in ALERT_MESSAGES.items()})
    return (
        lines.join(F.broadcast(totals), "alert_name")
        .withColumn("message_no", number)
        .withColumn("text", F.concat("line", repeated))
        .groupBy("alert_name", "event_count", "message_count", "message_no")
        .agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
        .select(
            "alert_name",
            subject.alias("subject"),
            "event_count",
            "message_no",
            "message_count",
            F.concat(opening, F.col("text")).alias("body"),
        )
    )
