"""Joins on keys that a large share of the rows may have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOOKUP_BYTES = 32_000_000
# What a row and a value take besides the bytes of texts.
ROW_BYTES, VALUE_BYTES = 32, 16


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes in memory."""
    row = F.lit(ROW_BYTES + VALUE_BYTES * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row += F.coalesce(F.octet_length(field.name), F.lit(0))
    return row


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory, from one aggregate."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
    limit: int = LOOKUP_BYTES,
) -> DataFrame:
    """Join ``facts`` to a ``lookup`` of flat columns that is cheap to measure and usually small.

    Up to ``limit`` bytes it is sent to every task: the facts then stay where they are
    and later filters still reach their scan. A larger one is joined by shuffle, where
    the adaptive plan splits the keys that many facts share.
    """
    if measured_bytes(lookup) <= limit:
        lookup = F.broadcast(lookup)
    return facts.join(lookup, on, how)


def salted_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join ``facts`` to a far smaller ``lookup`` with each key cut into ``salts`` parts.

    There are as many parts as the session's shuffles have, so a hot key is spread
    over as many tasks as all rows are.

    The salt is the input partition of a fact row: it stays the same when a lost
    task runs again, and it spreads identical rows, which a hash of their values
    would not. Every lookup row is repeated once per salt. Only for joins that
    keep or drop fact rows (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat lookup rows")
    salts = salts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted_facts = facts.withColumn("_salt", F.spark_partition_id() % salts)
    salted_lookup = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_facts.join(salted_lookup, [*on, "_salt"], how).drop("_salt")
