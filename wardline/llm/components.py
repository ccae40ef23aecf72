"""Connected components of a graph given as pairs, as Spark joins and minima."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import session
from wardline.llm import common


def smallest_reachable(edges: DataFrame, a_task: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; long), root the smallest it reaches.

    Alternates the two star steps: every larger neighbour is hung to the smallest
    neighbour of its node, then every node's smaller neighbours to the smallest of
    them. Both are a minimum (summed up before the shuffle) and a join that the
    adaptive split may cut, so no node's neighbours are ever gathered in one place,
    and the number of pairs never grows. Ends when a round changes nothing. With
    ``a_task`` a round over few pairs is one job, with a task for so many of them.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = common.cut_lineage(pairs.distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        with session.few_tasks(pairs.sparkSession, state[0] if a_task else sys.maxsize, a_task or 1):
            pairs = common.cut_lineage(small)
        last, state = state, _state(pairs)
        if last == state:
            break
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    """Number of pairs and an order-free digest of them."""
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
