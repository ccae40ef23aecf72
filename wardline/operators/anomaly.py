"""Behavioural signals over query, access and login history.

Signals that look at sensitive objects keep one row per query: the objects a
query touched are tested in place, never joined out. Hot users are summed on
the map side before anything is shuffled by user.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.constants import (
    PHI_EXCLUDED_USERS,
    PHI_LOGIN_ROLES,
    PHI_OBJECT_PATTERN,
    PII_TAGS,
    SPIKE_EXCLUDED_USERS,
)
from wardline.functions import ago, as_timestamp, ilike_any, live, lookup_join, touching, within
from wardline.functions.clock import parse
from wardline.operators.audit import COLUMN_KEY, pii_tagged_columns
from wardline.operators.rolegraph import literal_roles, role_edges, role_reach

DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def volume_spike(
    query_history: DataFrame,
    as_of,
    lookback_days: int = 8,
    deviations: float = 2.0,
    excluded: Iterable[str] = SPIKE_EXCLUDED_USERS,
) -> DataFrame:
    """Users whose rows today exceed the mean of their active days by ``deviations``.

    The baseline and today come from one pass over the daily sums. Both figures
    are reported unrounded.
    """
    daily = (
        query_history.filter(
            within(query_history, "start_time", as_of, days=lookback_days)
            & ~ilike_any(F.col("user_name"), excluded)
        )
        .groupBy("user_name", F.to_date("start_time").alias("query_date"))
        .agg(F.sum("rows_produced").alias("rows_day"))
    )
    return volume_spikes(daily, as_of, deviations)


def volume_spikes(daily: DataFrame, as_of, deviations: float) -> DataFrame:
    """The spikes among sums of users' days (user_name, query_date, rows_day)."""
    today = F.lit(parse(as_of).date().isoformat()).cast("date")
    before = F.col("query_date") < today
    per_user = daily.groupBy("user_name").agg(
        F.sum(F.when(F.col("query_date") == today, F.col("rows_day"))).alias("rows_today"),
        F.avg(F.when(before, F.col("rows_day"))).alias("avg_7d_baseline"),
        F.coalesce(F.stddev_samp(F.when(before, F.col("rows_day"))), F.lit(0.0)).alias("spread"),
    )
    limit = F.col("avg_7d_baseline") + deviations * F.col("spread")
    return (
        per_user.filter((F.col("avg_7d_baseline") > 0) & (F.col("rows_today") > limit))
        .select(
            "user_name",
            "rows_today",
            "avg_7d_baseline",
            (F.col("rows_today") / F.col("avg_7d_baseline")).alias("multiple_of_baseline"),
            F.lit("DATA_VOLUME_SPIKE").alias("signal"),
        )
        .orderBy(F.desc("multiple_of_baseline"))
    )


def _phi_queries(query_history, access_history, as_of, days, pattern, excluded=()) -> DataFrame:
    """Distinct queries in the window that touched an object like ``pattern``."""
    queries = query_history.filter(within(query_history, "start_time", as_of, days=days))
    if excluded:
        queries = queries.filter(~ilike_any(F.col("user_name"), excluded))
    queries = queries.select("query_id", "user_name", "start_time", "rows_produced")
    window = within(access_history, "query_start_time", as_of, days=days)
    return touching(queries, access_history, pattern, window).distinct()


def off_hours_access(
    query_history: DataFrame,
    access_history: DataFrame,
    as_of,
    time_zone: str,
    first_hour: int = 6,
    last_hour: int = 21,
    days: int = 30,
    pattern: str = PHI_OBJECT_PATTERN,
    excluded: Iterable[str] = PHI_EXCLUDED_USERS,
) -> DataFrame:
    """Sensitive reads outside local business hours or at the weekend.

    Times without a zone are taken as UTC.
    """
    zoned = isinstance(query_history.schema["start_time"].dataType, T.TimestampType)
    stored = F.current_timezone() if zoned else F.lit("UTC")
    local = F.convert_timezone(stored, F.lit(time_zone), F.col("query_start_time"))
    dow = F.dayofweek(local) - 1
    sessions = (
        _phi_queries(query_history, access_history, as_of, days, pattern, excluded)
        .groupBy("user_name", F.col("start_time").alias("query_start_time"))
        .agg(F.sum("rows_produced").alias("rows_produced"))
    )
    return (
        sessions.select(
            "user_name",
            "query_start_time",
            F.hour(local).alias("hour_local"),
            dow.alias("dow"),
            "rows_produced",
        )
        .filter(~F.col("hour_local").between(first_hour, last_hour) | F.col("dow").isin(0, 6))
        .select(
            "user_name",
            "query_start_time",
            "hour_local",
            F.array(*map(F.lit, DAY_NAMES))[F.col("dow")].alias("day_of_week"),
            "rows_produced",
            F.lit("OFF_HOURS_PHI_ACCESS").alias("signal"),
        )
        .orderBy(F.desc_nulls_first("query_start_time"))
    )


def novel_client_ip(
    login_history: DataFrame,
    grants_to_users: DataFrame,
    as_of,
    roles: Iterable[str] = PHI_LOGIN_ROLES,
    recent_days: float = 1,
    grants_to_roles: DataFrame | None = None,
) -> DataFrame:
    """Addresses a sensitive-role user signed in from for the first time.

    Only direct holders count unless ``grants_to_roles`` is given, which adds
    those who inherit a role. ``first_seen`` is the latest recent login.

    The history is read once and narrowed to role holders before it is grouped, so
    only their distinct (user, address) pairs are shuffled. One aggregate answers
    both "seen recently" and "seen before".
    """
    window = F.col("event_timestamp") <= as_timestamp(login_history, "event_timestamp", as_of)
    logins = login_history.filter((F.col("is_success") == "YES") & window)
    cutoff = ago(login_history, "event_timestamp", as_of, days=recent_days)
    holders = sensitive_role_holders(grants_to_users, as_of, roles, grants_to_roles)
    pairs = (
        lookup_join(logins, holders, ["user_name"], "left_semi")
        .groupBy("user_name", "client_ip")
        .agg(
            F.min("event_timestamp").alias("earliest"),
            F.max("event_timestamp").alias("first_seen"),
        )
    )
    return novel_addresses(pairs.withColumnRenamed("first_seen", "latest"), cutoff)


def novel_addresses(pairs: DataFrame, cutoff: Column) -> DataFrame:
    """Of pairs of user and address (earliest, latest) those first seen since ``cutoff``."""
    # An unknown address never matches an earlier one.
    is_new = (F.col("earliest") >= cutoff) | F.col("client_ip").isNull()
    return (
        pairs.filter((F.col("latest") >= cutoff) & is_new)
        .select(
            "user_name",
            F.col("client_ip").alias("novel_ip"),
            F.col("latest").alias("first_seen"),
            F.lit("NOVEL_CLIENT_IP").alias("signal"),
        )
        .orderBy(F.desc("first_seen"))
    )


def sensitive_role_holders(
    grants_to_users: DataFrame, as_of, roles: Iterable[str] = PHI_LOGIN_ROLES,
    grants_to_roles: DataFrame | None = None,
) -> DataFrame:
    """(user_name) of direct holders of ``roles``, and with ``grants_to_roles`` of all others."""
    grants = live(grants_to_users, as_of)
    if grants_to_roles is None:
        holders = grants.filter(F.col("role").isin(*roles))
    else:
        seed = literal_roles(grants.sparkSession, roles)
        reach = role_reach(seed, role_edges(grants_to_roles)).select("role")
        holders = lookup_join(grants, reach, ["role"], "left_semi")
    return holders.select(F.col("grantee_name").alias("user_name")).distinct()


def mass_export(
    query_history: DataFrame,
    access_history: DataFrame,
    as_of,
    min_rows: int = 10_000,
    days: int = 30,
    pattern: str = PHI_OBJECT_PATTERN,
    excluded: Iterable[str] = PHI_EXCLUDED_USERS,
) -> DataFrame:
    """Single queries that took more than ``min_rows`` rows from sensitive tables.

    Access history names the user here, so it carries the user into the join.
    """
    accessed = (
        access_history.filter(
            within(access_history, "query_start_time", as_of, days=days)
            & F.exists("base_objects_accessed", lambda o: o["objectName"].ilike(pattern))
            & ~ilike_any(F.col("user_name"), excluded)
        )
        .select("query_id", "query_start_time", "user_name")
        .distinct()
    )
    large = query_history.filter(
        within(query_history, "start_time", as_of, days=days) & (F.col("rows_produced") > min_rows)
    ).select(
        "query_id",
        F.col("start_time").alias("query_start_time"),
        "rows_produced",
        F.left("query_text", F.lit(300)).alias("query_text_excerpt"),
    )
    return (
        large.join(accessed, ["query_id", "query_start_time"])
        .select(
            "user_name", "query_start_time", "rows_produced", "query_text_excerpt", "query_id",
            F.lit("MASS_EXPORT").alias("signal"),
        )
        .distinct()
        .orderBy(F.desc("rows_produced"))
    )


def empty_result_probe(
    query_history: DataFrame,
    access_history: DataFrame,
    as_of,
    min_zero: int = 10,
    ratio: float = 0.5,
    days: int = 30,
    pattern: str = PHI_OBJECT_PATTERN,
) -> DataFrame:
    """Users who, in a day, kept getting nothing back from sensitive tables.

    ``pct_empty`` has one decimal, rounded half up.
    """
    share = F.col("zero_row_queries").cast("double") / F.col("total_queries")
    return (
        _phi_queries(query_history, access_history, as_of, days, pattern)
        .groupBy("user_name", F.to_date("start_time").alias("query_date"))
        .agg(
            F.count("*").alias("total_queries"),
            F.count_if(F.col("rows_produced") == 0).alias("zero_row_queries"),
        )
        .filter((F.col("zero_row_queries") > min_zero) & (share > ratio))
        .select(
            "user_name",
            "query_date",
            "total_queries",
            "zero_row_queries",
            (F.floor(share * 1000 + 0.5) / 10).alias("pct_empty"),
            F.lit("HIGH_EMPTY_RESULT_RATE").alias("signal"),
        )
        .orderBy(F.desc("zero_row_queries"), F.desc("query_date"))
    )


def untagged_sensitive_columns(
    classified: DataFrame, tag_references: DataFrame, tags: Iterable[str] = PII_TAGS
) -> DataFrame:
    """Columns a classifier finds sensitive that carry no tag.

    ``classified`` has table_catalog, table_schema, table_name, column_name,
    semantic_category and privacy_category.
    """
    key = ["table_catalog", "table_schema", "table_name", "column_name"]
    tagged = pii_tagged_columns(tag_references, tags).select(
        *[F.col(ours).alias(theirs) for ours, theirs in zip(COLUMN_KEY, key)]
    )
    return (
        classified.filter(F.col("privacy_category").isNotNull())
        .join(tagged, key, "left_anti")
        .select(
            *key, "semantic_category", "privacy_category",
            F.lit("UNTAGGED_PHI_CANDIDATE").alias("signal"),
        )
        .orderBy(F.asc_nulls_last("table_name"), F.asc_nulls_last("column_name"))
    )


def classified_from_map(
    findings: DataFrame, table_catalog: str, table_schema: str, table_name: str
) -> DataFrame:
    """Rows from a classifier result keyed by column name (column ``result``, a map or JSON)."""
    if isinstance(findings.schema["result"].dataType, T.StringType):
        kind = "map<string, struct<semantic_category: string, privacy_category: string>>"
        findings = findings.select(F.from_json("result", kind).alias("result"))
    return findings.select(F.explode("result").alias("column_name", "found")).select(
        F.lit(table_catalog).alias("table_catalog"),
        F.lit(table_schema).alias("table_schema"),
        F.lit(table_name).alias("table_name"),
        "column_name",
        F.col("found.semantic_category").alias("semantic_category"),
        F.col("found.privacy_category").alias("privacy_category"),
    )


# Value patterns per category, most specific first, and the words a column name
# may carry. (category, privacy category, value pattern, name pattern)
RULES = (
    ("EMAIL", "IDENTIFIER", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "email"),
    ("US_SSN", "IDENTIFIER", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ssn"),
    ("IP_ADDRESS", "IDENTIFIER", r"^([0-9]{1,3}\.){3}[0-9]{1,3}$", "ip_addr"),
    ("MEDICAL_RECORD", "IDENTIFIER", r"^MRN-?[0-9]+$", "mrn"),
    ("DATE_OF_BIRTH", "QUASI_IDENTIFIER", None, "dob|birth"),
    ("NAME", "IDENTIFIER", r"^[A-Z][a-z]+( [A-Z][a-z]+)+$", "(full|first|last|patient)_?name"),
)


def classify_columns(
    df: DataFrame,
    rules: Iterable[tuple] = RULES,
    min_ratio: float = 0.8,
    sample: float | None = None,
) -> DataFrame:
    """(column_name, semantic_category, privacy_category, match_ratio) of likely PII.

    A column gets the first category whose pattern fits at least ``min_ratio``
    of its non-null values, or whose words are in its name. All columns and
    patterns are measured in one aggregate over the table; only that single row
    is turned on its side.
    """
    source = df if sample is None else df.sample(fraction=sample, seed=0)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rules = list(rules)
    ratios, entries = [], []
    for column in df.columns:
        found = F.lit(None)
        for at, (category, privacy, values, names) in reversed(list(enumerate(rules))):
            by_name = F.lit(column).rlike(f"(?i){names}")
            ratio = F.lit(None).cast("double")
            if values is not None and column in text:
                label = f"r{at}_{column}"
                ratios.append(F.avg(F.col(f"`{column}`").rlike(values).cast("double")).alias(label))
                ratio = F.col(f"`{label}`")
            fits = by_name | F.coalesce(ratio >= min_ratio, F.lit(False))
            hit = F.struct(
                F.lit(column).alias("column_name"),
                F.lit(category).alias("semantic_category"),
                F.lit(privacy).alias("privacy_category"),
                ratio.alias("match_ratio"),
            )
            found = F.when(fits, hit).otherwise(found)
        entries.append(found)
    measured = source.agg(*(ratios or [F.count("*").alias("n")]))
    return measured.select(F.explode(F.array_compact(F.array(*entries))).alias("hit")).select(
        "hit.*"
    )
