"""Lineages: records with parents of smaller id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stored import store

#: Rounds of generations between two looks at all pairs found.
LOOK_BACK = 4


def edges(records: DataFrame, node: str = "id", parents: str = "parents") -> DataFrame:
    """(child, parent), each pair once."""
    return records.select(F.col(node).alias("child"), F.explode(F.array_distinct(parents)).alias("parent"))


def ancestors(edge: DataFrame) -> DataFrame:
    """(node, ancestor) for every ancestor, the node itself excluded.

    Each round goes one generation up from the pairs that the last one found. Every LOOK_BACK rounds those already known
    are taken out, so that the whole is shuffled seldom, a pair is followed LOOK_BACK times at most, and cycles end.
    """
    edge = store(edge)
    new = store(edge.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    found, rounds = [new], 0
    while new.limit(1).count():
        rounds += 1
        up = new.join(edge, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        if rounds % LOOK_BACK == 0:
            if len(found) > 16:  # keeps the plan short
                found = [store(reduce(DataFrame.union, found).distinct())]
            up = up.join(reduce(DataFrame.union, found), ["node", "ancestor"], "left_anti")
        new = store(up)
        found.append(new)
    return reduce(DataFrame.union, found).where("node != ancestor").distinct()


def depths(edge: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): the longest path up from each node; `roots` has the nodes without parents.

    Each round goes one generation down and keeps a node once; the last round that reaches a node is its depth. Rows on a
    cycle below a root have no longest path and raise a ValueError.
    """
    edge = store(edge.select("child", "parent").distinct())
    level = store(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    found, generation = [level], 0
    nodes = edge.select("child").distinct().count()
    while level.limit(1).count():
        generation += 1
        if generation > nodes + 1:
            raise ValueError("the lineage has a cycle")
        down = level.join(edge, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        if len(found) > 16:
            found = [store(reduce(DataFrame.union, found).groupBy("node").agg(F.max("depth").alias("depth")))]
        level = store(down.withColumn("depth", F.lit(generation)))
        found.append(level)
    return reduce(DataFrame.union, found).groupBy("node").agg(F.max("depth").alias("depth"))


def rollup(records: DataFrame, role: str, parents: str = "parents") -> DataFrame:
    """For each role: records, distinct parents, records of one parent only, and records without."""
    distinct = F.size(F.array_distinct(parents))
    return records.groupBy(role).agg(F.count("*").alias("records"), F.count_if(distinct == 1).alias("clones"), F.count_if(distinct == 0).alias("roots"), F.sum(distinct).alias("parent_links"))


def violations(records: DataFrame, node: str = "id", parents: str = "parents") -> DataFrame:
    """(node, rule): parents that are not smaller, are named twice, or do not exist; ids that occur twice."""
    edge = records.select(F.col(node).alias("node"), F.explode(parents).alias("parent"))
    order = edge.where("parent >= node").select("node", F.lit("order").alias("rule"))
    twice = edge.groupBy("node", "parent").count().where("count > 1").select("node", F.lit("twice"))
    missing = edge.join(records.select(F.col(node).alias("parent")), "parent", "left_anti").select("node", F.lit("missing"))
    repeated = records.groupBy(F.col(node).alias("node")).count().where("count > 1").select("node", F.lit("repeated"))
    return order.union(twice).union(missing).union(repeated).distinct()
