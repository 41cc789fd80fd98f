"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two equi-joins and two aggregates on the current edge table; nothing but the
count of nodes that are not settled (one row) reaches the driver.  Each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    # the row that holds the least end links its own node, the others link their ends
    own = F.col("b") == F.col("m")
    return down.join(least, "a").select(F.when(own, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes of distinct edges (a > b) that have two smaller ends, or one and are one themselves; without any, edges are stars around each component's smallest node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.where("ups > 1 or ups = 1 and least = 0").count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, root) for every node of ``edges`` (columns a, b of one orderable type).

    root is the smallest node reachable.  Self-loops, repeats and either direction are allowed; null
    ends are dropped; an empty edge table gives an empty result.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = cut(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not _unsettled(now):
            break
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
