"""Masking policies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.constants import REDACTED


def mask_string(value: Column, unmask: bool) -> Column:
    """The value, or a fixed marker. A null is replaced too, so it tells nothing."""
    return value if unmask else F.lit(REDACTED)


def mask_date(value: Column, unmask: bool) -> Column:
    """The date, or January 1st of its year."""
    return value if unmask else F.trunc(value, "year")
