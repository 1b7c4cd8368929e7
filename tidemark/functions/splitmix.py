"""SplitMix64 words and unbiased bounded indices, addressed by their place: Arrow functions with arithmetic that wraps at 64 bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stored import store

#: Words of a stream that are made and numbered together.
BLOCK = 1024


def _words(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    # The generator's step, multipliers and shifts.
    z = seed.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word(seed: Column, place: Column) -> Column:
    """The word at a place (from 1) of a seed's stream, as a long: places are addressed directly, nothing is walked."""

    @F.pandas_udf("long")
    def words(seed: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(_words(seed.to_numpy(np.int64), place.to_numpy(np.int64)).astype(np.int64))

    return words(seed.cast("long"), place.cast("long"))


def candidate(seed: Column, place: Column, bound: Column) -> Column:
    """The word at a place modulo the bound; null where the word is below 2^64 mod bound and must be rejected."""

    @F.pandas_udf("long")
    def candidates(seed: pd.Series, place: pd.Series, bound: pd.Series) -> pd.Series:
        z, n = _words(seed.to_numpy(np.int64), place.to_numpy(np.int64)), bound.to_numpy(np.int64).astype(np.uint64)
        out = pd.Series((z % n).astype(np.int64), dtype="Int64")
        return out.mask(z < (np.uint64(0) - n) % n)

    return candidates(seed.cast("long"), place.cast("long"), bound.cast("long"))


def bounded_indices(streams: DataFrame, keys: list[str], seed: str, bound: str, draws: int) -> DataFrame:
    """(keys, draw, index): for each stream, `draws` indices below its bound, each equally likely.

    A word below 2^64 mod bound is rejected and the next one taken, so a draw's place among the words depends on those
    before it. Words are made in blocks; the blocks' counts of accepted words, added up, number the draws, and no task
    holds a stream. When a stream has too few words, more blocks are made, as often as it takes. Streams with null seeds
    or bounds, or bounds below 1, give no rows; keys must be unique.
    """
    streams = store(streams.select(*keys, F.col(seed).cast("long").alias("seed"), F.col(bound).cast("long").alias("bound")).where("seed is not null and bound >= 1"))
    done, blocks, first = [], -(-draws // BLOCK), 0
    counts = None
    while True:
        size = min(BLOCK, draws + 8)  # short streams need no whole block
        made = streams.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(first + blocks - 1)).cast("array<long>")))
        made = made.withColumn("place", F.explode(F.sequence(F.col("block") * size + 1, (F.col("block") + 1) * size)))
        index = candidate(F.col("seed"), F.col("place"), F.col("bound"))
        done.append(store(made.select(*keys, "block", "place", index.alias("index")).where("index is not null")))
        accepted = done[-1].groupBy(*keys, "block").agg(F.count("*").alias("n"))
        counts = store(accepted if counts is None else accepted.unionByName(counts))
        enough = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= draws).select(*keys)
        streams_left = store(streams.join(enough, keys, "left_anti"))
        first, blocks = first + blocks, 2 * blocks
        if not streams_left.limit(1).count():
            break
        streams = streams_left
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "block").orderBy("place")
    numbered = every.withColumn("nth", F.row_number().over(inside) - 1).join(starts, [*keys, "block"])
    return numbered.select(*keys, (F.col("start") + F.col("nth")).alias("draw"), "index").where(F.col("draw") < draws)
