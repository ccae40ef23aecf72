"""Row conditions used across the audit, anomaly and alert operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.clock import Moment, as_timestamp


def live(df: DataFrame, as_of: Moment | None = None) -> DataFrame:
    """Rows that are not soft-deleted, or were not yet at ``as_of``."""
    kept = F.col("deleted_on").isNull()
    if as_of is not None:
        kept |= F.col("deleted_on") > as_timestamp(df, "deleted_on", as_of)
    return df.filter(kept)


def ilike_any(value: Column, patterns: Iterable[str]) -> Column:
    """True if any pattern matches; ``~ilike_any`` negates the whole test.

    ``_`` stands for any character, so ``SVC_%`` also matches ``SVCX1``; write
    ``SVC\\_%`` for a literal underscore.
    """
    return reduce(lambda left, right: left | right, [value.ilike(p) for p in patterns])


def reads_object(pattern: str) -> Column:
    """Whether a row of access history touched an object like ``pattern``."""
    return F.exists(
        "base_objects_accessed", lambda accessed: accessed["objectName"].ilike(pattern)
    )


def touching(queries: DataFrame, access_history: DataFrame, pattern: str, window: Column) -> DataFrame:
    """Queries with an access record in ``window`` that touched ``pattern``, one row per query.

    The array is tested in place instead of exploded, so a query that touched
    many objects is never multiplied. Repeated access records collapse before
    the shuffle.
    """
    accessed = (
        access_history.filter(window & reads_object(pattern))
        .select("query_id", F.col("query_start_time").alias("start_time"))
        .distinct()
    )
    return queries.join(accessed, ["query_id", "start_time"], "left_semi")
