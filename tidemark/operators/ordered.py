"""Operators over ordered events of many keys: windows by key, never over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sequenced(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Add the 0-based place of each row in its key's order."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def last_label(df: DataFrame, key: str, label: str = "y") -> DataFrame:
    """Prediction by the label before; 0 for the first row."""
    return df.withColumn("pred", F.coalesce(F.lag(label).over(Window.partitionBy(key).orderBy("seq")), F.lit(0)))


def prefix_majority(df: DataFrame, key: str, label: str = "y") -> DataFrame:
    """Prediction by the majority of all labels before; ties and the first row give 0."""
    ones = F.sum(label).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("pred", F.coalesce((2 * ones > F.col("seq")).cast("int"), F.lit(0)))


def recent_loss(df: DataFrame, key: str, rows: int, miss: Column) -> DataFrame:
    """Misses and rows among the last `rows` rows."""
    frame = Window.partitionBy(key).orderBy("seq").rowsBetween(-(rows - 1), 0)
    return df.withColumn("recent_misses", F.sum(miss.cast("int")).over(frame)).withColumn("recent_rows", F.count("*").over(frame))


def error_curve(df: DataFrame, key: str, every: int, miss: Column) -> DataFrame:
    """Cumulative misses at every `every`-th row."""
    upto = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("misses", F.sum(miss.cast("int")).over(upto)).where((F.col("seq") + 1) % every == 0)


def latched(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """Once failed, failed ever after; a failed row's loss is 1."""
    upto = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("failed", F.max(failed.cast("int")).over(upto))


def chronology_violations(df: DataFrame, key: str, order: str, time: str, longest_gap: str) -> DataFrame:
    """Rows whose time runs back, whose place in the order repeats, or that follow too late, with the rule's name."""
    before = Window.partitionBy(key).orderBy(order)
    seen = df.withColumn("back", F.col(time) < F.lag(time).over(before)).withColumn("repeat", F.col(order) == F.lag(order).over(before)).withColumn("late", F.col(time) > F.lag(time).over(before) + F.expr(f"INTERVAL {longest_gap}"))
    rules = F.filter(F.array(*(F.when(F.col(r), r) for r in ("back", "repeat", "late"))), lambda r: r.isNotNull())
    return seen.select(key, order, F.explode(rules).alias("rule"))


def segment(seq: Column, n: Column, segments: int) -> Column:
    """The count window k that holds row seq when window k is [floor(k n / S), floor((k + 1) n / S))."""
    return F.floor(((seq + 1) * segments - 1) / n).cast("int")


def confusion(df: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    """Binary confusion counts, recalls and balanced accuracy; null where a class is absent."""
    count = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    counts = df.groupBy(*by).agg(count(1, 1).alias("tp"), count(1, 0).alias("fn"), count(0, 1).alias("fp"), count(0, 0).alias("tn"))
    recall_1, recall_0 = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.select(*by, "tp", "fn", "fp", "tn", F.round(recall_1, 6).alias("recall_1"), F.round(recall_0, 6).alias("recall_0"), F.round((recall_1 + recall_0) / 2, 6).alias("balanced_accuracy"))


def horizon_losses(df: DataFrame, key: str, horizons: list[int], miss: Column) -> DataFrame:
    """Misses within each horizon from a key's start, and the rows seen."""
    return df.groupBy(key).agg(*(F.count_if(miss & (F.col("seq") < h)).alias(f"loss_{h}") for h in horizons), F.count("*").alias("n"))


def gaps(df: DataFrame, key: str, order: str, first: int = 1) -> DataFrame:
    """(key, order, expected): rows whose number is not one more than the one before, nor `first` at a key's start."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    expected = F.coalesce(before + 1, F.lit(first)).cast("long")
    return df.select(key, F.col(order).cast("long").alias(order), expected.alias("expected")).where(F.col(order) != F.col("expected"))


def ends(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """First and last value of each key, by the order."""
    return df.groupBy(key).agg(*(f(v, order).alias(f"{name}_{v}") for v in values for name, f in (("first", F.min_by), ("last", F.max_by))))


def hash_chain(df: DataFrame, key: str, order: str, event: Column) -> DataFrame:
    """(key, events, chain): SHA-256 over the chain so far and each event in order. A key's events meet in one row, as a chain has no parts."""
    events = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), event.alias("e"))))
    chain = F.aggregate(events, F.lit(""), lambda h, x: F.sha2(F.concat(h, x["e"]).cast("binary"), 256))
    return df.groupBy(key).agg(F.count("*").alias("events"), chain.alias("chain"))


def duplicate_rank(df: DataFrame, items: list[str], *order: str) -> DataFrame:
    """Add the 1-based rank of each row among those with the same items."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*items).orderBy(*order)))


def class_losses(df: DataFrame, key: str, horizons: list[int], truth: str, pred: str) -> DataFrame:
    """For each horizon from a key's start: loss, errors and rows of both classes, and the mean of the classes' error rates (null without one of them)."""
    out = []
    for h in horizons:
        inside, miss = F.col("seq") < h, F.col(truth) != F.col(pred)
        count = lambda c, inside=inside: F.count_if(inside & c)
        e0, e1, n0, n1 = count(miss & (F.col(truth) == 0)), count(miss & (F.col(truth) == 1)), count(F.col(truth) == 0), count(F.col(truth) == 1)
        out += [e0.alias(f"errors_0_{h}"), e1.alias(f"errors_1_{h}"), n0.alias(f"n_0_{h}"), n1.alias(f"n_1_{h}"), F.round((F.try_divide(e0, n0) + F.try_divide(e1, n1)) / 2, 6).alias(f"balanced_error_{h}")]
    return df.groupBy(key).agg(*out)
