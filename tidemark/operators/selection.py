"""Selections within groups: survivors, tournaments, canonical orders, sites without their descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.addressing import uniform_at, uniform_index


def survivors(df: DataFrame, group: str, fitness: str, ordinal: str, keep: int) -> DataFrame:
    """The `keep` fittest of each group, ties to the smaller ordinal, with their rank."""
    order = Window.partitionBy(group).orderBy(F.col(fitness).desc(), F.col(ordinal))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def tournament(df: DataFrame, group: str, fitness: str, ordinal: str, rounds: int, size: int, key: str, role: str) -> DataFrame:
    """(group, round, winner): each round draws `size` members by addressed draws, with repeats, and the fittest wins, the first drawn among equals.

    Members are numbered in order of their ordinal. What is joined is the few draws of each round with single members.
    """
    numbered = df.select(group, F.col(fitness).alias("fit"), F.col(ordinal).alias("who"), (F.row_number().over(Window.partitionBy(group).orderBy(ordinal)) - 1).cast("long").alias("place"))
    sizes = numbered.groupBy(group).agg(F.count("*").alias("n"))
    drawn = sizes.select(group, "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("draw"))
    u = uniform_at(F.lit(key), F.concat(F.lit(f"{role}:"), F.col(group).cast("string")), F.col("round"), F.col("draw"))
    drawn = drawn.select(group, "round", "draw", uniform_index(u, F.col("n")).alias("place"))
    met = drawn.join(numbered, [group, "place"])
    return met.groupBy(group, "round").agg(F.max_by("who", F.struct("fit", -F.col("draw"))).alias("winner"))


def canonical(df: DataFrame, group: str, champion: Column, digest: Column) -> DataFrame:
    """Add each row's place in its group's canonical order: the champion first, the rest by digest."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(champion.cast("int").desc(), digest)))


def maximal_sites(sites: DataFrame, key: str, path: str) -> DataFrame:
    """Sites that lie below no other site of their key; a path's prefixes are the sites above it, so a path meets as many rows as it is deep."""
    above = sites.select(key, path, F.explode(F.sequence(F.lit(0), F.length(path) - 1)).alias("n")).where(F.length(path) > 0)
    below = above.select(key, path, F.col(path).substr(F.lit(1), F.col("n")).alias("above"))
    below = below.join(sites.select(key, F.col(path).alias("above")).distinct(), [key, "above"], "left_semi")
    return sites.join(below.select(key, path).distinct(), [key, path], "left_anti")
