"""Completeness, duplicates, digests and comparisons of tables."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import ranked

#: Rows of a task that compares keys, at most on average.
TASK_ROWS = 1 << 19


def key_differences(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side. A key with a null equals none, so it is on one side only.

    Both sides are dealt by key to as many tasks as their rows ask for, and each key is kept once.
    """
    a, b = expected.select(*keys, F.lit(1).alias("here"), F.lit(0).alias("there")), observed.select(*keys, F.lit(0).alias("here"), F.lit(1).alias("there"))
    both = a.unionByName(b)
    spark = both.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(both.count() / TASK_ROWS))
    found = both.repartition(tasks, *keys).groupBy(*keys).agg(F.max("here").alias("here"), F.max("there").alias("there"))
    no_match = reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys))
    sides = F.array(F.when((F.col("here") == 1) & ((F.col("there") == 0) | no_match), "missing"), F.when((F.col("there") == 1) & ((F.col("here") == 0) | no_match), "unexpected"))
    return found.select(*keys, F.explode(F.array_compact(sides)).alias("side"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def order_digest(df: DataFrame, order: str, line: Column, *by: str) -> DataFrame:
    """SHA-256 of each group's lines in order, every line ended by a newline.

    A group's lines meet in one row, so groups need a bound, such as the lines of one order; `range_digest` has none.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    text = F.concat(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"), F.lit("\n"))
    return df.groupBy(*by).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def range_digest(df: DataFrame, order: str, line: Column, rows: int = 4096) -> DataFrame:
    """(digest, ranges): one root over a table of any size. Lines are hashed in order within ranges of `rows` order numbers, and
    then the ranges' digests in order, likewise in two steps."""
    number = F.floor(F.col(order) / rows)
    ranges = order_digest(df.withColumn("range", number), order, line, "range").select("range", "digest")
    blocks = order_digest(ranges.withColumn("block", F.floor(F.col("range") / rows)), "range", F.col("digest"), "block").select("block", F.col("digest").alias("d"))
    return order_digest(blocks, "block", F.col("d")).crossJoin(F.broadcast(ranges.agg(F.count("*").alias("ranges"))))  # one row each


def multiset_digest(df: DataFrame, item: Column, *by: str) -> DataFrame:
    """SHA-256 of each group's (item, count) pairs, sorted: independent of order."""
    counts = df.select(*by, item.cast("string").alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n"))
    return order_digest(counts, "item", F.concat("item", F.lit("\t"), F.col("n").cast("string")), *by)


def diversity(df: DataFrame, item: Column, *by: str) -> DataFrame:
    """1 - sum k (k - 1) / (n (n - 1)) over the counts k of each group's items."""
    counts = df.select(*by, item.alias("item")).groupBy(*by, "item").agg(F.count("*").alias("k"))
    n = F.sum("k")
    return counts.groupBy(*by).agg(n.alias("n"), F.round(1 - F.try_divide(F.sum(F.col("k") * (F.col("k") - 1)), n * (n - 1)), 6).alias("diversity"))


def numeric_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str, absolute: float = 1e-12, relative: float = 1e-10) -> DataFrame:
    """Keys whose values differ by more than absolute + relative * |value|, or that one side lacks."""
    both = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys, "full")
    close = F.coalesce(F.abs(F.col("left") - F.col("right")) <= absolute + relative * F.abs("right"), F.lit(False))
    return both.where(~close)


def override(base: DataFrame, *layers: DataFrame, key: str, retired: DataFrame | None = None) -> DataFrame:
    """Rows by key from the last layer that has it, without retired keys."""
    stacked = base.withColumn("layer", F.lit(0))
    for n, layer in enumerate(layers, 1):
        stacked = stacked.unionByName(layer.withColumn("layer", F.lit(n)))
    rows = stacked.groupBy(key).agg(F.max_by(F.struct(*base.columns), "layer").alias("row")).select("row.*")
    return rows if retired is None else rows.join(retired.select(key), key, "left_anti")


def encoded(df: DataFrame, fitted: dict[str, list[str]]) -> DataFrame:
    """One-hot columns for the values known of each category column, one for others (UNKNOWN) and one for null (MISSING)."""
    slots = []
    for name, values in fitted.items():
        c = F.col(name)
        slots += [(c.eqNullSafe(v)).cast("int").alias(f"{name}_{i}") for i, v in enumerate(values)]
        slots += [(c.isNotNull() & ~c.isin(values)).cast("int").alias(f"{name}_unknown"), c.isNull().cast("int").alias(f"{name}_missing")]
    return df.select("*", *slots)


def fit_encoder(prefix: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(column, median, value, place): what a prefix of the rows teaches the encoder.

    A number column has one row, with its exact median; a category column has a row for each value, with its place from 0
    in the values' order. Places are given by ranges, so a column may have any number of values.
    """
    row = lambda c, median, value, place: (F.lit(c).alias("column"), median.cast("double").alias("median"), value.cast("string").alias("value"), place.cast("long").alias("place"))
    none = F.lit(None)
    fitted = [prefix.agg(F.percentile(c, 0.5).alias("m")).select(*row(c, F.col("m"), none, none)) for c in numbers]
    for c in categories:
        values = prefix.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct()
        fitted.append(ranked(values, F.col("v")).select(*row(c, none, F.col("v"), F.col("place") - 1)))
    return reduce(DataFrame.unionByName, fitted)


def encode_with(df: DataFrame, fitted: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Numbers with the prefix's median for missing ones and a flag; categories as their place among the prefix's values, -1
    if unknown and -2 if missing. Values are looked up by joins, small tables of them by broadcast ones."""
    medians = {r["column"]: r["median"] for r in fitted.where(F.col("column").isin(numbers)).collect()}  # a row a column
    out, looked = [], df
    for c in numbers:
        out += [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c), F.col(c).isNull().cast("int").alias(f"{c}_missing")]
    for k, c in enumerate(categories):
        values = fitted.where((F.col("column") == c) & F.col("value").isNotNull()).select(F.col("value").alias(f"_value_{k}"), F.col("place").alias(f"_place_{k}"))
        looked = looked.join(values, F.col(c).cast("string") == F.col(f"_value_{k}"), "left")
        out.append(F.when(F.col(c).isNull(), -2).otherwise(F.coalesce(F.col(f"_place_{k}").cast("int"), F.lit(-1))).alias(c))
    return looked.select(*[x for x in df.columns if x not in {*numbers, *categories}], *out)


def incomplete_groups(df: DataFrame, keys: list[str], member: str, wanted: list) -> DataFrame:
    """(keys, missing, extra): groups that do not have each wanted member exactly once."""
    counts = df.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("have"), F.count("*").alias("n"))
    every = F.array(*map(F.lit, wanted))
    found = counts.select(*keys, F.size(F.array_except(every, "have")).alias("missing"), (F.col("n") - F.size(F.array_intersect(every, "have"))).cast("int").alias("extra"))
    return found.where("missing > 0 or extra > 0")


def expected_keys(units: DataFrame, members: list, name: str) -> DataFrame:
    """Every unit with every member of a short fixed list: the key space that a design expects."""
    return units.withColumn(name, F.explode(F.array(*map(F.lit, members))))


def retention(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """|A and B| / |B| of each group's distinct items, with both sizes."""
    left, right = a.select(*keys, item).distinct(), b.select(*keys, item).distinct().withColumn("b", F.lit(1))
    both = right.join(left.withColumn("a", F.lit(1)), [*keys, item], "left")
    return both.groupBy(*keys).agg(F.count("a").alias("kept"), F.count("*").alias("of"), F.round(F.count("a") / F.count("*"), 6).alias("retained"))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule that is null for a row counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda r: r.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def tolerance(value: Column, other: Column, absolute: float = 1e-12, relative: float = 1e-10) -> Column:
    """Whether two numbers are as good as equal; nulls only equal each other."""
    return F.coalesce(F.abs(value - other) <= absolute + relative * F.abs(other), value.isNull() & other.isNull())
