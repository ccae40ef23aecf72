"""Findings kept up day by day or run by run, instead of from the whole past each time.

Each keeps a small table of what the past comes down to. Adding a day reads that day,
and adding it again changes nothing, so a job that failed half-way is simply run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas
from wardline.constants import SPIKE_EXCLUDED_USERS
from wardline.functions import as_timestamp, ilike_any, lookup_join
from wardline.functions.clock import parse
from wardline.operators.anomaly import novel_addresses, volume_spikes
from wardline.session import checkpointed
from wardline.sources.history import read_history

FIRST_SEEN = "user_name string, client_ip string, earliest timestamp_ntz, first_date date"
VOLUME = "user_name string, rows_day long, query_date date"


def _day(moment) -> dt.datetime:
    return parse(moment).replace(hour=0, minute=0, second=0, microsecond=0)


def _end_of(day: dt.datetime) -> dt.datetime:
    return day + dt.timedelta(days=1, microseconds=-1)


def _replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Write the days that ``rows`` has anew; other days stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


# First sight of an address ------------------------------------------------------


def _pairs(logins: DataFrame) -> DataFrame:
    return logins.filter(F.col("is_success") == "YES").groupBy("user_name", "client_ip").agg(
        F.min("event_timestamp").cast("timestamp_ntz").alias("earliest"),
        F.max("event_timestamp").cast("timestamp_ntz").alias("latest"),
    )


def start_first_seen(login_history: DataFrame, path: str, until) -> None:
    """Begin the table of first sights from all logins before the day of ``until``."""
    before = login_history.filter(
        F.col("event_timestamp") < as_timestamp(login_history, "event_timestamp", _day(until))
    )
    first = _pairs(before).drop("latest").withColumn("first_date", F.to_date("earliest"))
    first.write.mode("errorifexists").partitionBy("first_date").parquet(path)


def add_first_seen(spark: SparkSession, history_path: str, path: str, day) -> None:
    """Add the pairs of user and address that one day is the first to have.

    Reads that day of the logins, once. Of the table only earlier days are opened, and of
    them only the pairs that the day has get past the scan, as long as a day's pairs can be
    broadcast. A day added late may leave a pair under a later day as well; readers take
    the earliest.
    """
    start = _day(day)
    logins = read_history(
        spark, history_path, schemas.LOGIN_HISTORY, "event_timestamp", start, _end_of(start)
    )
    pairs = _pairs(logins).drop("latest")
    known = spark.read.schema(FIRST_SEEN).parquet(path).filter(
        F.col("first_date") < F.lit(start.date())
    )
    new = _unseen(pairs, known)
    _replace_days(new.withColumn("first_date", F.lit(start.date())), path, "first_date")


def _unseen(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` that ``known`` doesn't have. An unknown address never matches an earlier one."""
    on = ["user_name", "client_ip"]
    pairs, _ = checkpointed(pairs)
    seen = lookup_join(known.select(*on), pairs.select(*on), on, "left_semi")
    return pairs.join(seen, on, "left_anti")


def novel_client_ip_daily(
    spark: SparkSession, history_path: str, path: str, holders: DataFrame, as_of,
    recent_days: float = 1,
) -> DataFrame:
    """``anomaly.novel_client_ip`` from the stored first sights and the recent days alone.

    ``holders`` has user_name. Only the days from the start of the recent time on are
    read of the logins.
    """
    cutoff = parse(as_of) - dt.timedelta(days=recent_days)
    logins = read_history(
        spark, history_path, schemas.LOGIN_HISTORY, "event_timestamp", _day(cutoff), as_of
    )
    pairs = _pairs(lookup_join(logins, holders.select("user_name").distinct(), ["user_name"], "left_semi"))
    known = spark.read.schema(FIRST_SEEN).parquet(path).filter(
        F.col("first_date") < F.lit(cutoff.date())
    )
    return novel_addresses(_unseen(pairs, known), F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz"))


# Daily volumes ------------------------------------------------------------------


def _volumes(queries: DataFrame) -> DataFrame:
    return queries.groupBy("user_name", F.to_date("start_time").alias("query_date")).agg(
        F.sum("rows_produced").alias("rows_day")
    )


def start_volumes(query_history: DataFrame, path: str, until) -> None:
    """Begin the table of daily sums from all queries before the day of ``until``."""
    before = query_history.filter(
        F.col("start_time") < as_timestamp(query_history, "start_time", _day(until))
    )
    _volumes(before).write.mode("errorifexists").partitionBy("query_date").parquet(path)


def add_volumes(spark: SparkSession, history_path: str, path: str, day) -> None:
    """Add what each user read in one day; the day is all that is read."""
    start = _day(day)
    queries = read_history(
        spark, history_path, schemas.QUERY_HISTORY, "start_time", start, _end_of(start)
    )
    _replace_days(_volumes(queries), path, "query_date")


def volume_spike_daily(
    spark: SparkSession, history_path: str, path: str, as_of, lookback_days: int = 8,
    deviations: float = 2.0, excluded: Iterable[str] = SPIKE_EXCLUDED_USERS,
) -> DataFrame:
    """``anomaly.volume_spike`` from stored daily sums, for any ``as_of``.

    A day's sum is its own moments (count 1, mean, no deviation), so the baseline merges
    one row per user and day. Of the queries only today's are read, and those of the day
    in which the look-back begins, as it counts from that hour on.
    """
    today, begin = _day(as_of), parse(as_of) - dt.timedelta(days=lookback_days)

    def read(since, until) -> DataFrame:
        return read_history(spark, history_path, schemas.QUERY_HISTORY, "start_time", since, until)

    stored = spark.read.schema(VOLUME).parquet(path).filter(
        (F.col("query_date") > F.lit(begin.date())) & (F.col("query_date") < F.lit(today.date()))
    )
    daily = stored.unionByName(_volumes(read(begin, _end_of(_day(begin))))).unionByName(
        _volumes(read(today, as_of))
    )
    return volume_spikes(daily.filter(~ilike_any(F.col("user_name"), excluded)), today, deviations)


# Ages of exceptions -------------------------------------------------------------

AGING = "exception_id string, kind string, first_seen string, last_seen string, runs_seen long"


def advance_aging(state: DataFrame, run: DataFrame, run_id: str) -> DataFrame:
    """``conformance.exception_aging`` after one more run, from what it was before.

    ``run`` has the exception_id and kind of this run's exceptions. A run that is
    already in the state counts once.
    """
    now = run.select("exception_id", "kind").distinct().withColumn("run", F.lit(run_id))
    both = state.join(now, ["exception_id", "kind"], "full")
    again = F.col("run").isNotNull() & (F.col("last_seen").isNull() | (F.col("last_seen") < F.col("run")))
    return both.select(
        "exception_id", "kind",
        F.least("first_seen", "run").alias("first_seen"),
        F.greatest("last_seen", "run").alias("last_seen"),
        (F.coalesce("runs_seen", F.lit(0)) + again.cast("long")).alias("runs_seen"),
    )


def aged_report(exceptions: DataFrame, aging: DataFrame) -> DataFrame:
    """The exceptions with the run they were first seen in and in how many runs."""
    ages = aging.select("exception_id", "kind", "first_seen", "runs_seen")
    return exceptions.join(ages, ["exception_id", "kind"], "left")


def counts_by_team(history: DataFrame, teams: DataFrame) -> DataFrame:
    """Exceptions per run, and per run and team, and of those by severity (null: all).

    ``teams`` has identity and owner; who is in no team counts as UNOWNED. One pass gives
    all groupings; ``level`` tells which one a row belongs to.
    """
    met = lookup_join(history, teams.select("identity", "owner"), ["identity"], "left").withColumn(
        "owner", F.coalesce("owner", F.lit("UNOWNED"))
    )
    run, owner, severity = (F.col(c) for c in ("run_id", "owner", "severity"))
    level = F.when(F.grouping("owner") == 1, "run").when(F.grouping("severity") == 1, "team").otherwise("severity")
    return met.groupingSets(
        [[run], [run, owner], [run, owner, severity]], run, owner, severity
    ).agg(
        level.alias("level"), F.count("*").alias("exceptions"),
        F.countDistinct("identity").alias("identities"),
    )
