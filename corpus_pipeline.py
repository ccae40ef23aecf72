"""Documents to training sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; all but the last return the columns of ``documents``. Texts whose language
cannot be told go; one document of each group of fingerprints within three bits stays; documents
that hold a benchmark item go; secrets are masked; the rest is tokenized and packed.

Null and empty texts have no language and go at the first stage. Null ids, repeated
rows, other columns and empty tables are as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import session
from wardline.llm import decontaminate, langid, packing, secret_scan, simhash
from wardline.llm.common import remainder
from wardline.llm.queries import default_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.train(docs, remainder("doc_id", 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_tokenizer()).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.col("offset").cast("long").alias("offset"), "ids",
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_decontamination),
    ("secret_scan", secret_masking),
    ("packing", pack),
]

#: The stages are models, components and a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.tune(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = session.work_path(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
