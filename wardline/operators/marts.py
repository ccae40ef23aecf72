"""Staging view, mart and column tests over the protected patient table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.clock import parse
from wardline.sources.publish import publish


def stg_patients(patient: DataFrame) -> DataFrame:
    """Renamed columns of the (masked) patient source."""
    return patient.select(
        "patient_id",
        F.col("full_name").alias("patient_name"),
        "mrn",
        F.col("email").alias("patient_email"),
        F.col("dob").alias("date_of_birth"),
        "facility_id",
    )


def patients_by_facility(staged: DataFrame, as_of) -> DataFrame:
    """Distinct patients per facility. Holds no identifiers."""
    stamp = F.lit(parse(as_of).isoformat(sep=" ")).cast("timestamp_ntz")
    return (
        staged.groupBy("facility_id")
        .agg(F.countDistinct("patient_id").alias("patient_count"))
        .withColumn("mart_refreshed_at", stamp)
    )


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows that fail the test."""
    return df.filter(F.col(column).isNull())


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_records"))
        .filter(F.col("n_records") > 1)
    )


def column_tests(
    df: DataFrame, table: str, not_null: Iterable[str] = (), unique: Iterable[str] = ()
) -> DataFrame:
    """(table_name, column_name, test, failures). All null tests share one pass."""
    not_null, results = list(not_null), []

    def result(column, test, failures):
        return F.struct(
            F.lit(table).alias("table_name"),
            column.alias("column_name"),
            F.lit(test).alias("test"),
            failures.alias("failures"),
        )

    if not_null:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        rows = F.array(*[result(F.lit(c), "not_null", F.col(c)) for c in not_null])
        results.append(nulls.select(F.inline(rows)))
    for column in unique:
        failed = check_unique(df, column).agg(F.count("*").alias("n"))
        row = result(F.lit(column), "unique", F.col("n"))
        results.append(failed.select(row.alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, results)


def materialize(df: DataFrame, name: str, mode: str = "view", path: str | None = None) -> DataFrame:
    """Publish a model: staging as a view, a mart as a table.

    A table at a ``path`` is replaced in one step: its readers never see a part of it.
    """
    if mode == "view":
        df.createOrReplaceTempView(name)
        return df.sparkSession.table(name)
    if mode != "table":
        raise ValueError(f"unknown materialization {mode}")
    if path is None:
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    return publish(df, path)
