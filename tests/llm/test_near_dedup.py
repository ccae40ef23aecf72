"""What near-duplicate removal moves, and which rows it keeps."""

import pytest
from pyspark.sql import functions as F

from wardline.llm import common, simhash

SCHEMA = "doc_id long, text string"


@pytest.fixture
def unhinted(spark):
    """Joins as over large tables, where no side is small enough to be sent to every task."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield spark
    spark.conf.set(setting, before)


def _nodes(plan):
    yield plan
    children = plan.children()
    for n in range(children.length()):
        yield from _nodes(children.apply(n))


def test_whole_rows_are_shuffled_once(unhinted):
    docs = unhinted.createDataFrame([(n, f"text {n}") for n in range(9)], SCHEMA)
    marked = common.stored(docs.toDF("c0", "c1").withColumn("mark", F.xxhash64("c1")), "marked")
    roots = marked.select("mark", F.lit(1).cast("long").alias("root"))
    found = simhash.first_rows(marked, roots, docs)
    plan = found._jdf.queryExecution().executedPlan().initialPlan()
    moved = [n for n in _nodes(plan) if n.nodeName() == "Exchange" and "string" in n.schema().simpleString()]
    assert len(moved) == 1


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_first_rows_of_repeated_and_null_ids(unhinted, broadcast):
    unhinted.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rows = [
        (5, "b", 1), (5, "a", 1), (5, "a", 1), (7, "c", 1),  # repeated id, one group
        (3, "d", 2), (None, "e", 2),  # an id before none
        (None, "g", 3), (None, "f", 3), (None, None, 3),  # none at all
        (9, "h", 4), (2, "i", 5), (9, "j", 5),  # linked to another mark
    ]
    marked = unhinted.createDataFrame(rows, "c0 long, c1 string, mark long").repartition(3)
    roots = unhinted.createDataFrame([(4, 4), (5, 4)], "mark long, root long")
    docs = unhinted.createDataFrame([], SCHEMA)
    found = {tuple(r) for r in simhash.first_rows(marked, roots, docs).collect()}
    assert found == {(5, "a"), (3, "d"), (None, None), (2, "i")}
