"""Tables that are replaced as a whole, or not at all.

A version is written into a folder of its own, then read back: a manifest states its
rows and a digest of each of its files. Only then the pointer of the table is replaced,
in one step, so a write that fails at any point leaves readers the version before.
Versions that nothing points to any more are removed, except the last few. A table has
one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.evidence import row_text
from wardline.sources.files import Files

POINTER, MANIFEST = "_current", "_manifest"
KEPT = 2


def write_version(df: DataFrame, folder: str, partition_by: Iterable[str] = ()) -> None:
    """The rows of a version as Parquet. The adaptive plan gives a partition as many files as it needs."""
    by = list(partition_by)
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by])
    df.write.partitionBy(*by).parquet(folder)


def manifest_of(rows: DataFrame) -> DataFrame:
    """(file, rows, digest) of a version: an order-free sum of the hashes of a file's rows.

    Two sums of 64 bits each, of independent hashes, so that equal rows count as often
    as they are there and no file is gathered anywhere.
    """
    text = row_text(rows.columns)
    name = F.regexp_extract(F.input_file_name(), "/rows/(.*)$", 1)
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(text), F.xxhash64(text, F.lit(1)))]
    return rows.groupBy(name.alias("file")).agg(
        F.count("*").alias("rows"), F.concat_ws(":", *sums).alias("digest")
    )


def publish(
    df: DataFrame, path: str, partition_by: Iterable[str] = (), write=write_version
) -> DataFrame:
    """Replace the table at ``path`` by ``df`` and return it as it was stored."""
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    files = Files(spark, path)
    try:
        write(df, f"{folder}/rows", partition_by)
        stored = spark.read.schema(df.schema).parquet(f"{folder}/rows")
        manifest_of(stored).write.json(f"{folder}/{MANIFEST}")
        total = spark.read.schema("rows long").json(f"{folder}/{MANIFEST}").agg(F.sum("rows")).first()[0]
        before = _versions(files)
        entry = {"version": version, "rows": total or 0, "schema": df.schema.json()}
        files.replace(POINTER, json.dumps({"versions": [entry, *before][: KEPT + 1]}))
    except BaseException:
        files.remove(version)
        raise
    held = {v["version"] for v in _versions(files)}
    for name in files.names():
        if name.startswith("version-") and name not in held:
            files.remove(name)
    return read_published(spark, path)


def _versions(files: Files) -> list[dict]:
    return json.loads(files.read(POINTER))["versions"] if files.exists(POINTER) else []


def read_published(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The table as last published, or as ``back`` versions before."""
    entry = _versions(Files(spark, path))[back]
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{entry['version']}/rows")


def unlike_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of the published version that aren't as they were written, or aren't there."""
    entry = _versions(Files(spark, path))[0]
    folder = f"{path.rstrip('/')}/{entry['version']}"
    stated = spark.read.schema("file string, rows long, digest string").json(f"{folder}/{MANIFEST}")
    found = manifest_of(read_published(spark, path))
    on = ["file", "rows", "digest"]
    return stated.join(found, on, "left_anti").unionByName(found.join(stated, on, "left_anti")).select("file").distinct()
