"""Readers for governance tables and configuration. Schemas are checked, not guessed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.sources.files import Files


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; a missing or ill-typed one is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise ValueError(f"column {field.name} is missing")
        kind = have[field.name]
        both_times = {type(kind), type(field.dataType)} <= {T.TimestampType, T.TimestampNTZType}
        if not both_times and kind.simpleString() != field.dataType.simpleString():
            raise ValueError(
                f"column {field.name} is {kind.simpleString()}, not {field.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in schema.fields])


def parse_objects(access_history: DataFrame) -> DataFrame:
    """Access history whose objects arrive as JSON text or variant, with them as an array."""
    kind = access_history.schema["base_objects_accessed"].dataType
    wanted = schemas.ACCESS_HISTORY["base_objects_accessed"].dataType
    column = F.col("base_objects_accessed")
    if isinstance(kind, T.StringType):
        column = F.from_json(column, wanted)
    elif isinstance(kind, T.VariantType):
        column = F.variant_get(column, "$", wanted.simpleString())
    return access_history.withColumn("base_objects_accessed", column)


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One governance table below ``root``."""
    df = spark.read.format(fmt).load(f"{root.rstrip('/')}/{name}")
    if name == "access_history":
        df = parse_objects(df)
    return conform(df, schemas.TABLES[name])


def read_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in (names or schemas.TABLES)}


def _load_config(spark: SparkSession, path: str) -> dict:
    """A configuration file in any storage that Spark reads."""
    text = Files(spark, path).read()
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML; JSON works without it") from missing
    return yaml.safe_load(text) or {}


def read_role_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The approved role matrix (YAML or JSON), each entry with its place in the file."""
    rows = [
        (at, e["entra_group_id"], e.get("fr_roles", []), e.get("data_sensitivity"))
        for at, e in enumerate(_load_config(spark, path).get("entra_groups", []))
    ]
    return spark.createDataFrame(rows, schemas.ROLE_MATRIX)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The service-account inventory (YAML or JSON)."""
    rows = [
        (a["login_name"], a.get("expected_roles", []))
        for a in _load_config(spark, path).get("service_accounts", [])
    ]
    return spark.createDataFrame(rows, schemas.SERVICE_INVENTORY)


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    """Signed approvals: a JSON list in one file, each with its place in the list."""
    approvals = spark.read.schema(schemas.APPROVALS).json(path, multiLine=True)
    return approvals.withColumn("pos", F.monotonically_increasing_id())
