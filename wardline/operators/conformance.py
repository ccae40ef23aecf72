"""Checks that rules set elsewhere (networks, quotas, sessions, duties) were kept."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.constants import (
    ADMIN_ROLES,
    CREDIT_QUOTAS,
    IDLE_MINUTES,
    IMMEDIATE_SUSPEND_WORKLOADS,
    POLICY_AUTHOR_ROLE,
    QUOTA_STEPS,
    REDACTED,
    UNMASK_ROLE,
)
from wardline.functions import as_timestamp, live, lookup_join
from wardline.functions.network import address_key, disjoint, network_bounds, scoped, searched
from wardline.operators.rolegraph import literal_roles, role_closure, role_edges
from wardline.session import checkpointed

#: Networks up to this many bytes are searched in place; a row takes these besides its keys.
ALLOWLIST_BYTES, ROW_BYTES = 4_000_000, 64


def logins_outside_allowlist(
    login_history: DataFrame, cidrs: DataFrame, user_policies: DataFrame, default_policy: str
) -> DataFrame:
    """Logins from outside the networks of the user's own policy, or else the default.

    IPv4 and IPv6 alike; what is no address is outside. Of several policies of a user
    the first by name holds, so no login is reported twice.

    All networks are one sorted array that is sent along with the tasks: a login stays
    where it is scanned and is searched for in it. Where the array would take more than
    ``ALLOWLIST_BYTES``, distinct addresses meet the intervals in a shuffle, by policy
    and the leading digits that both have.
    """
    own = user_policies.groupBy("user_name").agg(F.min("policy_name").alias("policy_name"))
    logins = lookup_join(login_history, own, ["user_name"], "left").withColumn(
        "policy_name", F.coalesce("policy_name", F.lit(default_policy))
    )
    output = ["user_name", "client_ip", "event_timestamp", "is_success", "policy_name"]
    spans, seen = checkpointed(
        disjoint(network_bounds(cidrs)).select(
            scoped(F.col("policy_name"), F.col("low")).alias("low"),
            scoped(F.col("policy_name"), F.col("high")).alias("high"),
        ),
        size=F.sum(F.octet_length("low") * 2 + ROW_BYTES),
    )
    key = scoped(F.col("policy_name"), address_key(F.col("client_ip")))
    if (seen["size"] or 0) <= ALLOWLIST_BYTES:
        every = [(r["low"], r["high"]) for r in spans.collect()]
        return logins.filter(~searched(key, every)).select(*output)
    addresses = logins.select("policy_name", "client_ip").distinct().withColumn("key", key)
    inside = _inside(addresses.filter("key IS NOT NULL"), spans).select("policy_name", "client_ip")
    return logins.join(inside, ["policy_name", "client_ip"], "left_anti").select(*output)


#: Digits that an address and an interval must share to meet in a shuffle.
BLOCK_DIGITS = 4


def _inside(addresses: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``addresses`` whose key is in one of the disjoint ``spans``.

    An address meets the intervals that begin or end in its block, the addresses with the
    same leading digits, and is compared with those. Blocks that lie wholly inside an
    interval, at most 65,536 of a family, are listed instead: whoever is in one is inside.
    """

    def block(key: str) -> Column:
        # The policy, the family and the first digits: none of them is inside a name.
        return F.concat(
            F.substring_index(key, "\0", 1), F.lit("\0"),
            F.substring(F.substring_index(key, "\0", -1), 1, BLOCK_DIGITS + 1),
        )

    ended = spans.withColumn("first", block("low")).withColumn("last", block("high"))
    ends = ended.select("low", "high", F.explode(F.array_distinct(F.array("first", "last"))).alias("block"))
    keyed = addresses.withColumn("block", block("key"))
    in_end = keyed.join(ends, "block").filter(F.col("key").between(F.col("low"), F.col("high")))
    # Between its first and last block an interval holds every address: the blocks are named.
    number = F.conv(F.substring_index("first", "\0", -1), 16, 10).cast("long")
    until = F.conv(F.substring_index("last", "\0", -1), 16, 10).cast("long")
    policy = F.concat(F.substring_index("first", "\0", 1), F.lit("\0")).alias("policy")
    whole = ended.filter(until - number > 1).select(
        policy, F.explode(F.sequence(number + 1, until - 1)).alias("number")
    ).select(F.concat("policy", F.lower(F.hex("number"))).alias("block"))
    in_whole = keyed.join(whole.distinct(), "block", "left_semi")
    return in_end.select(*addresses.columns).union(in_whole.select(*addresses.columns)).distinct()


def quota_actions(
    usage: DataFrame,
    quotas: Mapping[str, float] = CREDIT_QUOTAS,
    steps: Mapping[int, str] = QUOTA_STEPS,
    immediate: Iterable[str] = IMMEDIATE_SUSPEND_WORKLOADS,
) -> DataFrame:
    """When each workload first reached each step of its monthly quota.

    ``usage`` has workload, metered_at and credits. Credits are metered by the
    hour, so a month is at most 744 sums however many usage rows it has; only
    those are put in order. Steps above 100 % apply to ``immediate`` workloads.
    """
    quota = F.lit(None).cast("double")
    for workload, credits in quotas.items():
        quota = F.when(F.col("workload") == workload, credits).otherwise(quota)
    hour = F.date_trunc("hour", "metered_at").cast(usage.schema["metered_at"].dataType)
    hourly = usage.groupBy("workload", hour.alias("metered_hour")).agg(
        F.sum("credits").alias("credits")
    )
    month = F.trunc("metered_hour", "month")
    running = (
        W.partitionBy("workload", "usage_month")
        .orderBy("metered_hour")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    rows = [
        F.struct(F.lit(pct).alias("step_pct"), F.lit(action).alias("action"))
        for pct, action in steps.items()
    ]
    applies = (F.col("step_pct") <= 100) | F.col("workload").isin(*immediate)
    return (
        hourly.withColumn("usage_month", month)
        .withColumn("used", F.sum("credits").over(running))
        .withColumn("quota", quota)
        .filter(F.col("quota").isNotNull())
        .select("*", F.inline(F.array(*rows)))
        .filter(applies & (F.col("used") * 100 >= F.col("quota") * F.col("step_pct")))
        .groupBy("workload", "usage_month", "step_pct", "action")
        .agg(
            F.min("metered_hour").alias("reached_at"),
            F.min("used").alias("credits_used"),
        )
    )


def idle_sessions(activity: DataFrame, idle_minutes: Mapping[str, int] = IDLE_MINUTES) -> DataFrame:
    """Sessions split where a user was idle longer than the limit of the session class.

    ``activity`` has user_name, session_class and ts. Activity within one slot
    as long as the limit can never be split, so it is first summed to one row
    per slot. A busy user then has no more rows than slots to put in order.
    """
    # A class that is not listed gets the strictest limit.
    limit = F.lit(min(idle_minutes.values()) * 60_000_000).cast("long")
    for name, minutes in idle_minutes.items():
        limit = F.when(F.col("session_class") == name, minutes * 60_000_000).otherwise(limit)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    slots = (
        activity.withColumn("at", micros)
        .groupBy(
            "user_name", "session_class", F.floor(F.col("at") / limit).alias("slot")
        )
        .agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"),
            F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
            F.count("*").alias("events"),
        )
    )
    per_user = W.partitionBy("user_name", "session_class").orderBy("first_at")
    idle = F.col("first_at") - F.lag("last_at").over(per_user)
    return (
        slots.withColumn("starts", F.coalesce((idle > limit).cast("int"), F.lit(1)))
        .withColumn("session_no", F.sum("starts").over(per_user))
        .groupBy("user_name", "session_class", "session_no")
        .agg(
            F.min("started_at").alias("session_start"),
            F.max("ended_at").alias("session_end"),
            F.sum("events").alias("events"),
        )
    )


def grants_at(grants: DataFrame, moment) -> DataFrame:
    """Grants as they stood at a past moment, as live rows."""
    at = as_timestamp(grants, "created_on", moment)
    held = (F.col("created_on") <= at) & (
        F.col("deleted_on").isNull() | (F.col("deleted_on") > at)
    )
    never = F.lit(None).cast(grants.schema["deleted_on"].dataType)
    return grants.filter(held).withColumn("deleted_on", never)


def privilege_diff(new: DataFrame, legacy: DataFrame) -> DataFrame:
    """Effective privileges that only one of two models gives, with ``change``."""
    columns = legacy.columns
    sides = new.select(*columns, F.lit(True).alias("in_new"), F.lit(False).alias("in_legacy"))
    sides = sides.union(legacy.select(*columns, F.lit(False), F.lit(True)))
    return (
        sides.groupBy(*columns)
        .agg(F.bool_or("in_new").alias("in_new"), F.bool_or("in_legacy").alias("in_legacy"))
        .filter(F.col("in_new") != F.col("in_legacy"))
        .select(*columns, F.when(F.col("in_new"), "GAINED").otherwise("LOST").alias("change"))
    )


def sod_violations(
    grants_to_users: DataFrame, grants_to_roles: DataFrame,
    role_a: str = UNMASK_ROLE, role_b: str = POLICY_AUTHOR_ROLE,
    forbidden: Iterable[str] = ADMIN_ROLES[:5],
) -> DataFrame:
    """(finding, subject, role): users who reach both roles, and
    built-in administrators that reach either."""
    seed = literal_roles(grants_to_roles.sparkSession, [role_a, role_b])
    closure = role_closure(seed, role_edges(grants_to_roles))
    reached = closure.select(F.col("top_role").alias("role"), "reachable_role")
    per_user = (
        lookup_join(live(grants_to_users), reached, ["role"])
        .groupBy(F.col("grantee_name").alias("subject"))
        .agg(
            F.bool_or(F.col("reachable_role") == role_a).alias("has_a"),
            F.bool_or(F.col("reachable_role") == role_b).alias("has_b"),
        )
        .filter(F.col("has_a") & F.col("has_b"))
        .select(
            F.lit("USER_REACHES_BOTH").alias("finding"), "subject",
            F.lit(f"{role_a}+{role_b}").alias("role"),
        )
    )
    admins = closure.filter(F.col("top_role").isin(*forbidden)).select(
        F.lit("ADMIN_REACHES").alias("finding"),
        F.col("top_role").alias("subject"),
        F.col("reachable_role").alias("role"),
    )
    return per_user.unionByName(admins)


def control_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Masking bindings that were there before and are gone now."""
    key = [
        "policy_name", "ref_database_name", "ref_schema_name", "ref_entity_name",
        "ref_column_name",
    ]
    masks = F.col("policy_kind") == "MASKING_POLICY"
    return (
        previous.filter(masks).select(*key)
        .subtract(current.filter(masks).select(*key))  # nulls are equal here
        .withColumn("finding", F.lit("MASKING_POLICY_REMOVED"))
    )


def exception_aging(history: DataFrame) -> DataFrame:
    """When each exception was first and last seen, and in how many runs."""
    return history.groupBy("exception_id", "kind").agg(
        F.min("run_id").alias("first_seen"),
        F.max("run_id").alias("last_seen"),
        F.countDistinct("run_id").alias("runs_seen"),
    )


def review_counts(history: DataFrame) -> DataFrame:
    """Exceptions per run, kind and severity, with totals (null kind or severity)."""
    return history.rollup("run_id", "kind", "severity").agg(
        F.count("*").alias("exceptions")
    ).filter(F.col("run_id").isNotNull())


def review_metrics(history: DataFrame, latest_run: str, sla_days: int = 31) -> DataFrame:
    """Per kind and severity: episodes, how many are open, days to remediate, share in SLA.

    Runs are months (``yyyy-MM``). An exception is remediated in the first
    monthly run that no longer reports it, and may come back later. No exception
    has more rows than there were runs.
    """
    run = F.to_date(F.concat("run_id", F.lit("-01")))
    seen = history.select("exception_id", "kind", "severity", run.alias("run")).distinct()
    per_exception = W.partitionBy("exception_id").orderBy("run")
    gap = F.lag("run").over(per_exception)
    latest = F.lit(f"{latest_run}-01").cast("date")
    closed = F.add_months("last_run", 1)
    episodes = (
        seen.withColumn("starts", (gap.isNull() | (F.add_months(gap, 1) < F.col("run"))).cast("int"))
        .withColumn("episode", F.sum("starts").over(per_exception))
        .groupBy("exception_id", "episode")
        .agg(
            F.max_by("kind", "run").alias("kind"),
            F.max_by("severity", "run").alias("severity"),
            F.min("run").alias("first_run"),
            F.max("run").alias("last_run"),
        )
        .withColumn(
            "days", F.when(F.col("last_run") < latest, F.datediff(closed, "first_run"))
        )
    )
    return episodes.groupBy("kind", "severity").agg(
        F.count("*").alias("episodes"),
        F.count_if(F.col("days").isNull()).alias("open_episodes"),
        F.avg(F.col("days").cast("double")).alias("mean_days_to_remediate"),
        F.avg(F.when(F.col("days").isNotNull(), (F.col("days") <= sla_days).cast("double"))).alias(
            "share_in_sla"
        ),
    )


# What a text must not carry outside: what a recogniser is called, its pattern, and how a
# match is told from one of another recogniser's. Earlier ones have the first say about a
# place, as a secret may hold digits that look like something else. A repeat ahead of a
# literal takes its whole run at once and begins only where the run does, so nothing of a
# long token is left over and long runs of letters cost no more.
_KEYS = r"(?i:token|password|passwd|pwd|secret|api[ _-]?key|access[ _-]?key)"
_WORD = r"\p{L}\p{M}\p{N}._%+-"
_GROUP = "[0-9A-Fa-f]{1,4}"
RECOGNISERS = (
    # A value in quotes goes up to the closing quote, any other to the next blank.
    (
        "SECRET",
        _KEYS + r"[\"']? *[=:] *(?:\"[^\"\n]*\"|'[^'\n]*'|\"?[^\s\"]+\"?)",
        "^" + _KEYS + r"[\"']? *[=:]",
    ),
    ("SECRET", r"\b(?i:bearer) +[A-Za-z0-9._~+/=-]{8,}+", "^(?i:bearer) "),
    (
        "EMAIL",
        rf"(?<![{_WORD}])[{_WORD}]++@[\p{{L}}\p{{M}}\p{{N}}-]+(?:\.[\p{{L}}\p{{M}}\p{{N}}-]+)+",
        "@",
    ),
    (
        "IP",
        rf"(?<![\w:.])(?:(?:{_GROUP}:){{7}}{_GROUP}"
        rf"|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})(?:(?:\.[0-9]{{1,3}}){{3}})?"
        rf"|{_GROUP}(?::{_GROUP}){{0,6}}::)(?![\w:])",
        "^[0-9A-Fa-f]*:[0-9A-Fa-f:.]*$",
    ),
    ("IP", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
    (
        "PHONE",
        r"\+[0-9]{1,3} ?(?:\([0-9]{2,4}\)[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}|[0-9]{2,4}(?:[ -][0-9]{3,4}){2,3})(?![0-9])",
        "^\\+",
    ),
    (
        "SSN",
        r"(?i:\bssn\b[ :#]*)[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"^(?i:ssn\b|[0-9]{3}-[0-9]{2}-[0-9]{4}$)",
    ),
    ("MRN", r"(?i:\bmrn)[ :#-]*[0-9]+", "^(?i:mrn)"),
    ("CARD", r"(?<![0-9-])(?:[0-9]{4}[ -]){3}[0-9]{1,4}(?![0-9-])|(?<![0-9-])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9-])", "[ -]"),
    ("NUMBER", "[0-9]{12,}+", ""),
)
# A text without any of these holds nothing that a recogniser knows.
SIGNS = "[0-9@=:]|(?i:bearer)"


def check_digit_holds(digits: Column) -> Column:
    """Whether a run of digits ends in the check digit of card numbers (every second one doubled)."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(place: Column) -> Column:
        value = F.substring(digits, -place, F.lit(1)).cast("int") * (2 - place % 2)
        return F.when(value > 9, value - 9).otherwise(value)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _marked(match: Column) -> Column:
    """What stands for a match: the marker of its recogniser. A group of digits that only
    looks like a card number stays."""
    marker = F.lit("[NUMBER]")
    for name, _, told in reversed(RECOGNISERS[:-1]):
        value = F.lit(f"[{name}]")
        if name == "CARD":
            value = F.when(check_digit_holds(F.regexp_replace(match, "[ -]", "")), value).otherwise(match)
        marker = F.when(match.rlike(told), value).otherwise(marker)
    return marker


def scrub_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The table with secrets and identifiers in ``column`` replaced by markers.

    One pass: a text is cut at everything any recogniser knows, each piece is told by
    what it looks like and put back as its marker. ``scrubbed`` tells which rows changed.
    """
    every = "|".join(f"(?:{pattern})" for _, pattern, _ in RECOGNISERS)
    text = F.col(column)
    matches = F.regexp_extract_all(text, F.lit(every), F.lit(0))
    between = F.split(text, every, -1)
    pieces = F.zip_with(
        between, F.transform(matches, _marked), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    )
    clean = F.when(text.rlike(SIGNS), F.array_join(pieces, "")).otherwise(text)
    changed = ~F.col("_clean").eqNullSafe(text)
    return df.withColumn("_clean", clean).withColumn("scrubbed", changed).withColumn(
        column, F.col("_clean")
    ).drop("_clean")


def small_cohorts(df: DataFrame, quasi_ids: Iterable[str], k: int) -> DataFrame:
    """Combinations of quasi-identifiers shared by fewer than ``k`` rows."""
    return (
        df.groupBy(*quasi_ids).agg(F.count("*").alias("cohort_size")).filter(F.col("cohort_size") < k)
    )


def redaction_rate(
    results: DataFrame, role: str, ts: str, strings: Iterable[str] = (), dates: Iterable[str] = ()
) -> DataFrame:
    """Per role and day, the share of returned values that were masked.

    A sudden rise for a cleared role means its members lost their primary role.
    """
    masked = [(F.col(c) == REDACTED) for c in strings]
    masked += [(F.month(c) == 1) & (F.dayofmonth(c) == 1) for c in dates]
    hits = sum((F.coalesce(m, F.lit(False)).cast("int") for m in masked), F.lit(0))
    return results.groupBy(F.col(role).alias("role_name"), F.to_date(ts).alias("day")).agg(
        F.count("*").alias("rows_returned"),
        F.sum(hits).alias("masked_values"),
        (F.sum(hits) / (F.count("*") * len(masked)).cast("double")).alias("masked_share"),
    )
