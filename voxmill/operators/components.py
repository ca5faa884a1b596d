"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a group-by of the neighbours of a node that keeps only their minimum in memory, so no
component and no node of high degree is ever collected; each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.session import cut_lineage


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """`edges` with m, the minimum of their u. The join is shuffled, and adaptive execution splits the partition of a star's centre."""
    return edges.join(least.hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = _with_least(down, least)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its least node.

    `edges` has two columns of one orderable type, in any direction, repeats and loops allowed. Null ends
    give no edge. Nodes without an edge to another node do not appear. An empty table gives an empty one.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    now = cut_lineage(now)
    mark = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected_components did not settle; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
