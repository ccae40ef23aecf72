"""Identifiers: stable exception ids and safely quoted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exception_id(kind: Column, identity: Column, role: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``kind|identity|role`` (no role: empty)."""
    text = F.concat_ws("|", kind, identity, F.coalesce(role, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
