"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import session

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def remainder(key: str, by: int) -> Column:
    """crc32 of a key written as text, modulo ``by``; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, and read from there."""
    session.checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table under the shared folder and read from there.

    Columnar, so that later steps read only what they need of wide rows.
    """
    spark: SparkSession = df.sparkSession
    path = session.work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that what a step makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns called c0, c1 and so on, so that none clashes with an added one."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)])


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1 and so on of ``rows`` under their names in ``docs``."""
    return rows.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)])


def extended(docs: DataFrame, **more: str) -> T.StructType:
    """The schema of ``docs`` and further columns."""
    added = T.StructType()
    for name, kind in more.items():
        added.add(name, kind)
    return T.StructType([*docs.schema.fields, *added.fields])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once.

    A column used several times inside array lambdas would otherwise be worked
    out again for each use; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
