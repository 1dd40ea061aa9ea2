"""Connected components by alternating stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); label is the smallest node reachable.

    Each round ties the larger neighbours of a node, then the node and its smaller ones,
    to the smallest of them; the rounds needed grow with the logarithm of the longest
    chain. Only minima per node are grouped, never lists of neighbours.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = scratch.keep(e, "edges0")
    before, turn = _state(e), 0
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        after = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{turn}")
        scratch.drop("large", f"edges{turn - 1}")
        e, now = after, _state(after)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
