"""Connected components of a graph given as a table of edges.

Every round points each node at the smallest of itself and its neighbours,
moves the edges to the nodes pointed at and drops those that became loops, so
the graph shrinks until no edge is left.  Rounds take the order of ids and a
hashed order in turn: stars vanish in one round of the first, and long paths
shrink by a constant share, on average, in each of the second.  Nodes of any
degree are reduced by partial aggregation; nothing is gathered per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; equal roots mean one component."""
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    live = scratch.table(live, "edges")
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = scratch.table(nodes.select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while live.head(1):
        order = F.col("b") if turn % 2 == 0 else F.xxhash64("b", F.lit(turn))
        own = F.col("a") if turn % 2 == 0 else F.xxhash64("a", F.lit(turn))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(order.alias("o"), F.col("b"))).alias("m"))
        step = best.select(F.col("a").alias("from"), F.least(F.struct(own.alias("o"), F.col("a").alias("b")), F.col("m"))["b"].alias("to"))
        step = scratch.table(step, "step")
        moved = live.join(step, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        moved = moved.join(step, F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
        following = scratch.table(moved.filter("a <> b").distinct(), "edges")
        new = where.join(step, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        new = scratch.table(new, "roots")
        scratch.drop(live, where, step)
        live, where, turn = following, new, turn + 1
    scratch.drop(live)
    return where
