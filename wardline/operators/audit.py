"""Audit pack: rosters, grant changes, control gaps and login checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.constants import DANGEROUS_PRIVILEGES, PII_TAGS, SERVICE_NAME_PATTERNS
from wardline.functions import ago, as_timestamp, ilike_any, live, within
from wardline.functions.clock import parse

COLUMN_KEY = ["object_database", "object_schema", "object_name", "column_name"]


def _first(*columns: str):
    return [F.asc_nulls_last(c) for c in columns]


def service_users(
    users: DataFrame,
    grants_to_users: DataFrame,
    patterns: Iterable[str] = SERVICE_NAME_PATTERNS,
) -> DataFrame:
    """Accounts that are, or look like, service users, with the roles they hold."""
    held = (
        live(grants_to_users)
        .groupBy(F.col("grantee_name").alias("service_user"))
        .agg(F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("roles_held"))
    )
    is_service = (
        (F.col("type") == "SERVICE")
        | (F.col("has_rsa_public_key") & ~F.col("has_password"))
        | ilike_any(F.col("name"), patterns)
    )
    return (
        live(users)
        .filter(is_service)
        .select(
            F.col("name").alias("service_user"), "type", "has_password", "has_rsa_public_key",
            "has_mfa", "disabled", "default_role", "default_warehouse", "owner",
            "last_success_login",
        )
        .join(held, "service_user", "left")
        .withColumn("roles_held", F.coalesce("roles_held", F.lit("")))
        .distinct()
        .orderBy(*_first("service_user"))
    )


def dormant_users(users: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Enabled users without a login in the window; never logged in comes first."""
    last = F.col("last_success_login")
    today = F.lit(parse(as_of).date().isoformat()).cast("date")
    idle = last.isNull() | (last < ago(users, "last_success_login", as_of, days=days))
    return (
        live(users, as_of)
        .filter(~F.col("disabled") & idle)
        .select(
            F.col("name").alias("user_name"), "type", "disabled", "created_on",
            "last_success_login",
            F.datediff(today, last).cast("bigint").alias("days_since_login"),
            "default_role", "owner",
        )
        .orderBy(F.desc_nulls_first("days_since_login"))
    )


def grant_changes(
    grants_to_roles: DataFrame, grants_to_users: DataFrame, as_of, days: int = 30
) -> DataFrame:
    """Grants given or taken back in the window, to roles and to users."""
    action = F.when(F.col("deleted_on").isNull(), "ADDED").otherwise("REVOKED")

    def changed(grants: DataFrame, scope: str, privilege, object_type, object_name) -> DataFrame:
        recent = within(grants, "created_on", as_of, days=days) | within(
            grants, "deleted_on", as_of, days=days
        )
        return grants.filter(recent).select(
            F.lit(scope).alias("change_scope"), "created_on", "deleted_on",
            action.alias("grant_action"), F.col("grantee_name").alias("role_name"),
            privilege.alias("privilege"), object_type.alias("object_type"),
            object_name.alias("object_name"), "granted_by",
        )

    to_roles = changed(
        grants_to_roles, "GRANT_TO_ROLE", F.col("privilege"), F.col("granted_on"), F.col("name")
    )
    to_users = changed(
        grants_to_users, "GRANT_TO_USER", F.lit("ROLE"), F.lit("USER"), F.col("role")
    )
    return to_roles.unionByName(to_users).orderBy(F.desc_nulls_first("created_on"))


def unused_roles(
    roles: DataFrame, query_history: DataFrame, as_of, days: int = 90, skip: str = "AR_"
) -> DataFrame:
    """Live roles that ran no query in the window.

    Access roles (prefix ``skip``) are only ever inherited, so they are left out.
    """
    used = (
        query_history.filter(
            within(query_history, "start_time", as_of, days=days)
            & F.col("role_name").isNotNull()
        )
        .select("role_name")
        .distinct()
    )
    return (
        live(roles, as_of)
        .select(F.col("name").alias("role_name"))
        .filter(~F.startswith("role_name", F.lit(skip)))
        .join(used, "role_name", "left_anti")
        .withColumn("finding", F.lit(f"NO QUERIES IN {days} DAYS"))
        .orderBy(*_first("role_name"))
    )


def over_privileged_roles(
    grants_to_roles: DataFrame, dangerous: Iterable[str] = DANGEROUS_PRIVILEGES
) -> DataFrame:
    """Roles with broad privileges, most first."""
    return (
        live(grants_to_roles)
        .filter(F.col("privilege").isin(*dangerous))
        .groupBy(F.col("grantee_name").alias("role_name"))
        .agg(
            F.count("*").alias("privilege_count"),
            F.array_join(F.sort_array(F.collect_set("privilege")), ", ").alias("privilege_list"),
        )
        .orderBy(F.desc("privilege_count"))
    )


def attestation_header(
    sections: Mapping[str, DataFrame], account: str, region: str, reviewer: str, as_of,
    review_type: str = "HIPAA Monthly Access Review",
) -> DataFrame:
    """The stamp of a review, one row for each exported section with its row count."""
    counted = [
        df.agg(F.count("*").alias("row_count")).withColumn("section", F.lit(name))
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, counted).select(
        F.lit(account).alias("account"),
        F.lit(region).alias("region"),
        F.lit(parse(as_of).isoformat(sep=" ")).cast("timestamp_ntz").alias("review_run_at"),
        F.lit(reviewer).alias("reviewer"),
        F.lit(review_type).alias("review_type"),
        "section",
        "row_count",
    )


def user_roster(users: DataFrame) -> DataFrame:
    """All live users and how they sign in."""
    return (
        live(users)
        .select(
            F.col("name").alias("user_name"), "type", "disabled", "created_on",
            "last_success_login", "has_password", "has_rsa_public_key", "has_mfa",
            "default_role", "email", "owner",
        )
        .orderBy(*_first("disabled", "user_name"))
    )


def policy_evidence(policy_references: DataFrame) -> DataFrame:
    """Columns and tables that a masking or row-access policy protects."""
    return (
        policy_references.filter(F.col("policy_kind").isin("MASKING_POLICY", "ROW_ACCESS_POLICY"))
        .select(
            "policy_name", "policy_kind", "ref_database_name", "ref_schema_name",
            "ref_entity_name", "ref_column_name",
        )
        .orderBy(*_first("ref_database_name", "ref_schema_name", "ref_entity_name"))
    )


def failed_logins(
    login_history: DataFrame, as_of, days: int = 30, min_failures: int = 5
) -> DataFrame:
    """Users with repeated failed logins in the window."""
    window = within(login_history, "event_timestamp", as_of, days=days)
    return (
        login_history.filter(window & (F.col("is_success") == "NO"))
        .groupBy("user_name")
        .agg(
            F.count("*").alias("failed_logins"),
            F.countDistinct("client_ip").alias("distinct_ips"),
            F.min("event_timestamp").alias("first_failure"),
            F.max("event_timestamp").alias("last_failure"),
        )
        .filter(F.col("failed_logins") >= min_failures)
        .orderBy(F.desc("failed_logins"))
    )


def pii_tagged_columns(tag_references: DataFrame, tags: Iterable[str] = PII_TAGS) -> DataFrame:
    return tag_references.filter(
        F.col("tag_name").isin(*tags) & F.col("column_name").isNotNull()
    )


def tagged_unmasked_columns(
    tag_references: DataFrame, policy_references: DataFrame, tags: Iterable[str] = PII_TAGS
) -> DataFrame:
    """Tagged columns without a masking policy: any row is a control gap."""
    masked = policy_references.filter(
        (F.col("policy_kind") == "MASKING_POLICY") & F.col("policy_name").isNotNull()
    ).select(
        F.col("ref_database_name").alias("object_database"),
        F.col("ref_schema_name").alias("object_schema"),
        F.col("ref_entity_name").alias("object_name"),
        F.col("ref_column_name").alias("column_name"),
    )
    return (
        pii_tagged_columns(tag_references, tags)
        .join(masked, COLUMN_KEY, "left_anti")
        .select(*COLUMN_KEY, "tag_name", "tag_value")
        .orderBy(*_first(*COLUMN_KEY))
    )


def mfa_posture(users: DataFrame) -> DataFrame:
    """Enabled people and their MFA flag; those without come first."""
    return (
        live(users)
        .filter(~F.col("disabled") & (F.col("type") == "PERSON"))
        .select(
            F.col("name").alias("user_name"), "type", "has_mfa", "has_password",
            "has_rsa_public_key", "default_role", "last_success_login",
        )
        .orderBy(*_first("has_mfa", "user_name"))
    )


def recent_failed_logins(login_history: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Failed logins in the window, newest first."""
    window = within(login_history, "event_timestamp", as_of, days=days)
    return (
        login_history.filter(window & (F.col("is_success") == "NO"))
        .select("user_name", "error_code", "error_message", "client_ip", "event_timestamp")
        .orderBy(F.desc_nulls_first("event_timestamp"))
    )


def recent_auth_events(authentication_history: DataFrame, as_of, hours: int = 2) -> DataFrame:
    """Authentication events in the window with all their columns, newest first."""
    window = within(authentication_history, "event_timestamp", as_of, hours=hours)
    return authentication_history.filter(window).orderBy(
        F.desc_nulls_first("event_timestamp")
    )


def recent_logins(
    login_history: DataFrame, as_of, hours: int = 1, user_name: str | None = None
) -> DataFrame:
    """Where logins in the window came from and how they ended."""
    recent = login_history.filter(
        (F.col("event_timestamp") > ago(login_history, "event_timestamp", as_of, hours=hours))
        & (F.col("event_timestamp") <= as_timestamp(login_history, "event_timestamp", as_of))
    )
    if user_name is not None:
        recent = recent.filter(F.col("user_name") == user_name)
    return recent.select(
        "client_ip", "user_name", "event_timestamp", "is_success", "error_code"
    ).orderBy(F.desc_nulls_first("event_timestamp"))


def alert_run_history(alert_history: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Alert runs in the window with their state and error."""
    return (
        alert_history.filter(within(alert_history, "scheduled_time", as_of, days=days))
        .select(
            F.col("name").alias("alert_name"), "scheduled_time", "completed_time", "state",
            "error_message",
        )
        .orderBy(F.desc_nulls_first("scheduled_time"))
    )


def column_tag_check(
    tag_references: DataFrame, column: str, tags: Iterable[str] = PII_TAGS
) -> DataFrame:
    """Tags on columns of this name. Any row means the column must not be indexed."""
    return tag_references.filter((F.col("column_name") == column) & F.col("tag_name").isin(*tags))


def policies_on(
    policy_references: DataFrame, entity: str, schema: str | None = None
) -> DataFrame:
    """All policies attached to one table or its columns."""
    attached = policy_references.filter(F.col("ref_entity_name") == entity)
    if schema is not None:
        attached = attached.filter(F.col("ref_schema_name") == schema)
    return attached


def grant_snapshot(grants_to_roles: DataFrame, grants_to_users: DataFrame) -> DataFrame:
    """All live grants, to roles and to users, as the baseline before a migration."""
    to_roles = live(grants_to_roles).select(
        F.lit("GRANT_TO_ROLE").alias("grant_scope"), "grantee_name", "privilege", "granted_on",
        "name", "table_catalog", "granted_by", "created_on",
    )
    to_users = live(grants_to_users).select(
        F.lit("GRANT_TO_USER").alias("grant_scope"), "grantee_name",
        F.col("role").alias("name"), "granted_by", "created_on",
    )
    return to_roles.unionByName(to_users, allowMissingColumns=True)
