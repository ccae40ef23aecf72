"""Session settings, and the shared folder that lineage is cut into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime settings only; cluster sizing stays with whoever starts the session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later step must then shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build(cores: str | int = "*", memory: str = "16g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Small data: keep all cores busy rather than merging into 1 MB tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors and the driver would not see the same files.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="wardline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The rows written once to the shared folder, and aggregates taken while they were."""
    checkpoint_dir(df.sparkSession)
    if not measures:
        return df.checkpoint(), {}
    seen = Observation()
    cut = df.observe(seen, *[c.alias(name) for name, c in measures.items()]).checkpoint()
    return cut, seen.get


#: Rows up to which a step is planned for few tasks, and rows for each of them.
FEW_ROWS, ROWS_A_TASK = 200_000, 50_000


@contextmanager
def few_tasks(spark: SparkSession, rows: int, a_task: int = ROWS_A_TASK) -> Iterator[None]:
    """Plan the eager steps inside for as few tasks as ``rows`` need, each in one job.

    Re-planning between the stages of a small step takes longer than the step. Beyond
    ``FEW_ROWS`` the session's own settings hold, with adaptive plans and skew splits.
    """
    if rows > FEW_ROWS:
        yield
        return
    partitions = "spark.sql.shuffle.partitions"
    most = int(spark.conf.get(partitions))
    own = {partitions: str(max(1, min(most, rows // a_task + 1))), "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, for tables that must be written."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
