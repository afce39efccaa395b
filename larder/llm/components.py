"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import drop, stored


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (node, root): each node of an edge with the smallest node reachable.

    Stars never hold a node's neighbours as a list: the least neighbour comes from an aggregate with
    partial sums. In the join back a hub's edges meet in one task unless adaptive execution splits
    that partition. The number of rounds grows with the logarithm of the longest path. Self-loops and
    nulls are dropped; no edges give no rows. Each round's tables go when the next ones are written.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "edges")
        # every edge points down now; each node hands its smaller neighbours to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, now = now, stored(small.distinct(), "edges")
        drop(before)
        drop(large)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
