"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Map every node of `links` (a, b: the same ordered type) to the smallest node it reaches.

    Returns (node, root).  Nodes without links do not appear.  An empty table gives an empty
    one.  Each round moves links towards smaller nodes with two grouped minima; links are
    written to the shared folder between rounds, and the loop ends when they stop changing.
    """
    current = stored(
        links.select("a", "b").filter("a != b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).distinct()
    )
    mark = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours go to the smallest node around it.
        around = _both_ways(current)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = around.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b")
        large = large.filter("a != b").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        small = (
            large.join(low, F.col("b") == F.col("node"))
            .select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .filter("a != b")
            .distinct()
        )
        current = stored(small)
        seen = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    tops = current.select(F.col("a").alias("node")).distinct()
    return roots.unionByName(tops.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
