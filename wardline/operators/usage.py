"""Usage register: who calls which AI and model-training functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.constants import AI_FUNCTIONS, ML_FUNCTIONS, PHI_DATABASE_PATTERN
from wardline.functions import ilike_any, within


def function_patterns(namespace: str, functions: Iterable[str]) -> list[str]:
    """Patterns that find calls of ``namespace.function`` in query texts."""
    return [f"%{namespace}.{name}%" for name in functions]


def _calls(query_history: DataFrame, patterns: list[str], as_of, days: int) -> DataFrame:
    return query_history.filter(
        within(query_history, "start_time", as_of, days=days)
        & ilike_any(F.col("query_text"), patterns)
    )


def ai_function_calls(
    query_history: DataFrame, namespace: str, as_of, days: int = 30,
    functions: Iterable[str] = AI_FUNCTIONS,
) -> DataFrame:
    """Calls of AI functions with an excerpt of the query, newest first."""
    return (
        _calls(query_history, function_patterns(namespace, functions), as_of, days)
        .select(
            "user_name", "role_name", "start_time",
            F.left("query_text", F.lit(400)).alias("query_excerpt"),
        )
        .orderBy(F.desc_nulls_first("start_time"))
    )


def ml_training_calls(
    query_history: DataFrame, namespace: str, as_of, days: int = 30,
    functions: Iterable[str] = ML_FUNCTIONS,
) -> DataFrame:
    """Calls that train models, with the whole query, newest first."""
    return (
        _calls(query_history, function_patterns(namespace, functions), as_of, days)
        .select("user_name", "role_name", "start_time", "query_text")
        .orderBy(F.desc_nulls_first("start_time"))
    )


def ai_calls_on_phi(
    query_history: DataFrame, access_history: DataFrame, namespace: str, as_of, days: int = 30,
    pattern: str = PHI_DATABASE_PATTERN,
) -> DataFrame:
    """Each sensitive object an AI call read. Here one row per object is wanted."""
    window = within(access_history, "query_start_time", as_of, days=days)
    accessed = access_history.filter(window).select(
        "user_name",
        "query_id",
        "query_start_time",
        F.filter(
            F.transform("base_objects_accessed", lambda o: o["objectName"]),
            lambda name: name.ilike(pattern),
        ).alias("objects"),
    )
    calls = query_history.filter(
        within(query_history, "start_time", as_of, days=days)
        & F.col("query_text").ilike(f"%{namespace}.%")
    ).select(
        "query_id",
        F.col("start_time").alias("query_start_time"),
        F.left("query_text", F.lit(300)).alias("query_excerpt"),
    ).distinct()
    return (
        accessed.filter(F.size("objects") > 0)
        .join(calls, ["query_id", "query_start_time"])
        .select(
            "user_name", "query_start_time", F.explode("objects").alias("accessed_object"),
            "query_excerpt",
        )
        .distinct()
        .orderBy(F.desc_nulls_first("query_start_time"))
    )
