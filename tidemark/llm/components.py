"""Connected components as DataFrame joins: alternating large and small stars until every node points at its smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import LEAST_TASKS, TASK_ROWS, store


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether every node has one edge, to a node that has none itself."""
    ends = edges.select(F.col("big").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(edges.select("small", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return not seen.coalesce(tasks).where("out > 1 or (out = 1 and root = 1)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of an edge other than a loop.

    Each round moves neighbours to the smallest node seen, so the number of rounds grows with the logarithm of a
    component's size. A hub's rows are aggregated before they are joined, the minima are stored so that either side of
    the join is a plain exchange that adaptive execution can split, and each round is written to the shared folder.
    `rows` may bound the number of edges. Null ends are left out; repeated and reversed edges count once; no edges give no rows.
    """
    u, v = F.col(a), F.col(b)
    every = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("big"), F.least(u, v).alias("small")).distinct()
    now = store(every) if rows is None else store(every, rows)
    n = 2 * now.count()  # no round has more edges or nodes
    while not _settled(now, max(LEAST_TASKS, n // TASK_ROWS)):
        # Large star: every larger neighbour of a node points at the smallest neighbour.
        both = now.select(F.col("big").alias("node"), F.col("small").alias("other")).union(now.select("small", "big"))
        least = store(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least")), n)
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("big"), F.col("least").alias("small")).distinct()
        # Small star: a node's smaller neighbours point at the smallest of them.
        large = store(large, n)
        least = store(large.groupBy("big").agg(F.min("small").alias("least")), n)
        joined = large.join(least, "big")
        moved = joined.where("small != least").select(F.col("small").alias("big"), F.col("least").alias("small"))
        now = store(moved.union(least.select("big", "least")).distinct(), n)
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).union(now.select("small", "small").distinct())
