"""Policy-enforcing reads: row entitlements first, then masks by column tag.

``protect`` is the only thing to hand to users. Masks follow the primary role
and what it inherits; row entitlements also count activated secondary roles, so
the two can only differ by showing rows whose columns stay masked.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.constants import FULL_ROW_ROLES, PII_TAGS, UNMASK_ROLE
from wardline.functions import lookup_join, mask_date, mask_string
from wardline.operators.rolegraph import (
    _inherited_roles,
    holds_privilege,
    literal_roles,
    role_edges,
)


@dataclass(frozen=True)
class SessionRoles:
    """Roles of one session, each with whether the primary role holds it."""

    held: DataFrame

    @classmethod
    def resolve(
        cls, spark: SparkSession, edges: DataFrame, primary: str, secondary: Iterable[str] = ()
    ) -> "SessionRoles":
        active = [primary.upper(), *[role.upper() for role in secondary]]
        inherited = _inherited_roles(literal_roles(spark, set(active)), edges)
        held = inherited.groupBy(F.col("effective_role").alias("role")).agg(
            F.bool_or(F.col("held_role") == primary.upper()).alias("in_primary")
        )
        return cls(held.checkpoint())

    def primary_has_role(self, role: str) -> bool:
        """Whether the primary role holds ``role``; secondary roles do not count."""
        return not self.held.filter((F.col("role") == role) & F.col("in_primary")).isEmpty()

    def session_has_role(self, *roles: str) -> bool:
        """Whether any active role holds one of ``roles``."""
        return not self.held.filter(F.col("role").isin(*roles)).isEmpty()


def session_roles(active: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, role, in_primary) for many sessions at once.

    ``active`` has one row per activated role: session_id, role, is_primary.
    """
    held = active.select("session_id", F.upper("role").alias("held_role"), "is_primary")
    roles = held.select(F.col("held_role").alias("role_name")).distinct()
    return (
        held.join(_inherited_roles(roles, edges), "held_role")
        .groupBy("session_id", F.col("effective_role").alias("role"))
        .agg(F.bool_or("is_primary").alias("in_primary"))
    )


def apply_tag_masks(
    df: DataFrame, tag_references: DataFrame, table: str, session: SessionRoles,
    unmask_role: str = UNMASK_ROLE, untagged: bool = False,
) -> DataFrame:
    """Mask every column of ``table`` (``database.schema.name``) that carries a PII tag.

    Tags are read at call time, so a column tagged later is masked from then on. Names
    are compared without case. A table without any tag is an error, as its name may be
    wrong, unless the caller states with ``untagged`` that it has none.
    A tag that does not fit its column's type is an error: better than clear text.
    """
    if session.primary_has_role(unmask_role):
        return df
    database, schema, name = table.split(".")
    by_name = {c.lower(): c for c in df.columns}
    # At most one row per column and tag of this one table.
    tags = (
        tag_references.filter(
            (F.upper("object_database") == database.upper())
            & (F.upper("object_schema") == schema.upper())
            & (F.upper("object_name") == name.upper())
        )
        .select(F.lower("column_name").alias("column_name"), F.upper("tag_name").alias("tag_name"))
        .distinct()
        .collect()
    )
    if not tags and not untagged:
        raise LookupError(f"no tag is known for {table}")
    masks = {}
    for tag in tags:
        if tag.tag_name not in PII_TAGS or tag.column_name not in by_name:
            continue
        column = by_name[tag.column_name.lower()]
        kind = df.schema[column].dataType
        if tag.tag_name == "PII_STRING" and isinstance(kind, T.StringType):
            masks[column] = mask_string(F.col(column), False)
        elif tag.tag_name == "PII_DATE" and isinstance(kind, T.DateType):
            masks[column] = mask_date(F.col(column), False)
        else:
            raise TypeError(f"no {tag.tag_name} mask for {column} of type {kind.simpleString()}")
    return df.select(*[masks.get(c, F.col(c)).alias(c) for c in df.columns])


def row_access(
    df: DataFrame, entitlements: DataFrame, session: SessionRoles,
    key: str = "facility_id", full_row_roles: Iterable[str] = FULL_ROW_ROLES,
) -> DataFrame:
    """All rows for a full-row role, else the rows of entitled facilities."""
    if session.session_has_role(*full_row_roles):
        return df
    entitled = (
        entitlements.withColumn("role", F.upper("role_name"))
        .join(session.held, "role", "left_semi")
        .select(F.col("facility_id").alias(key))
        .distinct()
    )
    return lookup_join(df, entitled, [key], "left_semi").select(*df.columns)


def protect(
    df: DataFrame, tag_references: DataFrame, entitlements: DataFrame, table: str,
    session: SessionRoles, key: str = "facility_id",
) -> DataFrame:
    """What a session may see of a table."""
    return apply_tag_masks(
        row_access(df, entitlements, session, key), tag_references, table, session
    )


def visibility_report(
    df: DataFrame, entitlements: DataFrame, roles: DataFrame, edges: DataFrame,
    key: str = "facility_id", full_row_roles: Iterable[str] = FULL_ROW_ROLES,
    unmask_role: str = UNMASK_ROLE,
) -> DataFrame:
    """(role, rows_visible, columns_clear) of a table for each role as a primary role.

    The table is counted per facility first; only those counts meet the roles.
    """
    inherited = _inherited_roles(roles, edges)
    whole = F.col("effective_role").isin(*full_row_roles)
    # One scope per facility, and one for the whole table.
    counts = (
        df.rollup(key)
        .agg(F.grouping(key).cast("boolean").alias("whole_table"), F.count("*").alias("n"))
        .filter(F.col("whole_table") | F.col(key).isNotNull())
        .select("whole_table", F.coalesce(F.col(key), F.lit("")).alias("scope"), "n")
    )
    entitled = entitlements.select(
        F.upper("role_name").alias("effective_role"),
        F.lit(False).alias("whole_table"),
        F.col("facility_id").alias("scope"),
    ).distinct()
    scopes = (
        inherited.join(entitled, "effective_role")
        .select("held_role", "whole_table", "scope")
        .union(inherited.filter(whole).select("held_role", F.lit(True), F.lit("")))
        .distinct()
    )
    visible = (
        scopes.join(counts, ["whole_table", "scope"])
        .groupBy("held_role")
        .agg(
            F.max(F.when(F.col("whole_table"), F.col("n"))).alias("all_rows"),
            F.sum(F.when(~F.col("whole_table"), F.col("n"))).alias("entitled_rows"),
        )
    )
    flags = inherited.groupBy("held_role").agg(
        F.bool_or(F.col("effective_role") == unmask_role).alias("columns_clear")
    )
    return flags.join(visible, "held_role", "left").select(
        F.col("held_role").alias("role"),
        F.coalesce("all_rows", "entitled_rows", F.lit(0)).alias("rows_visible"),
        "columns_clear",
    )


def authorize(
    role: str, object_name: str, grants_to_roles: DataFrame, privilege: str = "SELECT",
    others: Iterable[str] = (),
) -> bool:
    """Whether ``role`` or one of ``others`` holds or inherits ``privilege`` on an object.

    Without it a read is refused outright rather than masked.
    """
    role_names = [role, *others]
    asked = literal_roles(grants_to_roles.sparkSession, [r.upper() for r in role_names])
    return holds_privilege(asked, grants_to_roles, object_name, privilege)


def guarded_read(
    df: DataFrame, table: str, grants_to_roles: DataFrame, tag_references: DataFrame,
    entitlements: DataFrame, primary: str, secondary: Iterable[str] = (),
    object_name: str | None = None,
) -> DataFrame:
    """``protect`` for a session that must also hold SELECT on the table."""
    secondary = list(secondary)
    name = object_name or table
    if not authorize(primary, name, grants_to_roles, others=secondary):
        raise PermissionError(f"{table} does not exist or not authorized")
    session = SessionRoles.resolve(
        df.sparkSession, role_edges(grants_to_roles), primary, secondary
    )
    return protect(df, tag_references, entitlements, table, session)
