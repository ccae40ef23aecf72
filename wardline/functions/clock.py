"""Literals for the moment a report is run at."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = dt.datetime | str


def parse(as_of: Moment) -> dt.datetime:
    return as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(as_of)


def as_timestamp(df: DataFrame, column: str, moment: Moment) -> Column:
    """``moment`` in the type of ``df[column]``.

    The literal is cast, never the column, so that a comparison with it still
    reaches the Parquet scan.
    """
    text = parse(moment).isoformat(sep=" ")
    return F.lit(text).cast(df.schema[column].dataType)


def within(df: DataFrame, column: str, as_of: Moment, **delta: float) -> Column:
    """Whether ``df[column]`` is in the time of length ``delta`` that ends at ``as_of``."""
    return F.col(column).between(ago(df, column, as_of, **delta), as_timestamp(df, column, as_of))


def ago(df: DataFrame, column: str, as_of: Moment, **delta: float) -> Column:
    return as_timestamp(df, column, parse(as_of) - dt.timedelta(**delta))
