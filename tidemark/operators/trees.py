"""Decision-tree operators as relational plans."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stored import store

#: Values that are swept in one task, on average at most.
TASK_ROWS = 1 << 18


def long_features(rows: DataFrame, row_id: str, vector: str, label: Column) -> DataFrame:
    """(row_id, y, feature, value) with one row for each component."""
    return rows.select(F.col(row_id).alias("row_id"), label.alias("y"), F.posexplode(vector).alias("feature", "value"))


def dealt(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """`rows` in tasks of some TASK_ROWS components of their vectors each, and how many such tasks there are."""
    values = rows.agg(F.sum(F.size(vector).cast("long"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(values / TASK_ROWS))
    return rows.repartition(tasks), tasks


def value_counts(rows: DataFrame, *by: str, tasks: int | None = None) -> DataFrame:
    """Rows and ones of each distinct value of each feature: what the sweep needs, aggregated before any window.

    With `tasks` the rows are counted in that many, and a value may have several rows, one for each task of `rows` that held
    it: `_swept` adds them up.
    """
    keys = [*by, "feature", "value"]
    if tasks:
        keys.append("part")
        rows = rows.withColumn("part", F.spark_partition_id()).repartition(tasks, *keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).drop("part")


def midpoint(a: Column, b: Column) -> Column:
    """Half-way from a to a larger b, without overflow; b itself where halves round to a, so that a row of value a stays left of it."""
    m = a / 2 + b / 2
    return F.when((m > a) & (m <= b), m).otherwise(b)


def _swept(counts: DataFrame, *by: str, total: Callable[[str], Column] = F.sum) -> DataFrame:
    """Each value with nl and ol, the rows and ones up to it, nt and ot, those of its feature at its node, and the value after it.

    Several rows of one value become one by `total`. Where there are more than TASK_ROWS rows, they are dealt to ranges of
    their order, as many as that asks for; a range's sums are added to those of the ranges before it, so no feature's values
    meet in one task.
    """
    keys = [*by, "feature"]
    counts = store(counts.select(*keys, "value", "n", "ones"))
    rows, of = counts.count(), keys
    merged = [total("n").alias("n"), total("ones").alias("ones")]
    if rows > TASK_ROWS:
        tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / TASK_ROWS))
        ranged = counts.repartitionByRange(tasks, *keys, "value").groupBy(*keys, "value").agg(*merged)  # within the ranges
        counts = store(ranged.withColumn("range", F.spark_partition_id()))
        swept, of = counts.repartition(tasks, "range"), [*keys, "range"]
    else:
        swept = counts.groupBy(*keys, "value").agg(*merged)
    order = Window.partitionBy(*of).orderBy("value")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*of)
    swept = swept.select(*of, "value", F.sum("n").over(upto).alias("nl"), F.sum("ones").over(upto).alias("ol"), F.lead("value").over(order).alias("after"), *(() if rows > TASK_ROWS else (F.sum("n").over(whole).alias("nt"), F.sum("ones").over(whole).alias("ot"))))
    if rows <= TASK_ROWS:
        return swept
    ranges = counts.groupBy(*of).agg(F.sum("n").alias("rn"), F.sum("ones").alias("ro"), F.min("value").alias("first"))
    ranged = Window.partitionBy(*keys).orderBy("range")
    earlier, every = ranged.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranges = ranges.select(*(F.col(c).alias(f"its_{c}") for c in of), F.coalesce(F.sum("rn").over(earlier), F.lit(0)).alias("bn"), F.coalesce(F.sum("ro").over(earlier), F.lit(0)).alias("bo"), F.lead("first").over(ranged).alias("next"), F.sum("rn").over(every).alias("nt"), F.sum("ro").over(every).alias("ot"))
    # A row for each feature of a node, and for each range: stored, so that the join knows how few they are.
    joined = swept.join(store(ranges), [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in of])
    return joined.select(*keys, "value", (F.col("nl") + F.col("bn")).alias("nl"), (F.col("ol") + F.col("bo")).alias("ol"), "nt", "ot", F.coalesce("after", "next").alias("after"))


def best_split(counts: DataFrame, *by: str, min_leaf: int = 1) -> DataFrame:
    """The Gini split of each node: feature, threshold (midpoint of neighbours), impurity; the first feature and place win ties."""
    swept = _swept(counts, *by)
    nr, ones_r = F.col("nt") - F.col("nl"), F.col("ot") - F.col("ol")
    # n times Gini: 2 * ones * zeros / n, on both sides.
    impurity = 2 * F.col("ol") * (F.col("nl") - F.col("ol")) / F.col("nl") + 2 * ones_r * (nr - ones_r) / nr
    cuts = swept.where(F.col("after").isNotNull() & (F.col("nl") >= min_leaf) & (nr >= min_leaf)).withColumn("impurity", F.round(impurity / F.col("nt"), 9)).withColumn("threshold", midpoint(F.col("value"), F.col("after")))
    best = F.min_by(F.struct("feature", "threshold", "impurity", F.col("nl").alias("left_rows")), F.struct("impurity", "feature", "value")).alias("best")
    return (cuts.groupBy(*by).agg(best) if by else cuts.agg(best)).select(*by, "best.*").where("feature is not null")


def candidate_thresholds(rows: DataFrame, count: int) -> DataFrame:
    """(feature, slot, cut): up to `count` midpoints of neighbouring distinct values, at evenly spaced places; a lone value is its own cut.

    Of V values, slot k of S = min(count, V - 1) is after the value at place floor(k (V - 1) / (S + 1)). Equal cuts count once.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / TASK_ROWS))
    values = value_counts(rows.select("feature", "value", F.lit(0).alias("y")), tasks=tasks).withColumn("n", F.lit(1).cast("long"))
    swept = _swept(values, total=F.max).select("feature", "value", "after", (F.col("nl") - 1).alias("place"), (F.col("nt") - 1).alias("gaps"))
    slots = F.least(F.lit(count).cast("long"), F.col("gaps"))
    # The first slot whose place is not before this value's, and which is here if its place is this one.
    first = F.greatest(F.ceil(F.col("place") * (slots + 1) / F.col("gaps")), F.lit(1).cast("long"))
    slot = F.when(F.col("gaps") == 0, F.lit(0).cast("long")).otherwise(first)
    here = (F.col("gaps") == 0) | ((F.col("slot") <= slots) & (F.floor(F.col("slot") * F.col("gaps") / (slots + 1)) == F.col("place")))
    cut = F.when(F.col("after").isNull(), F.col("value")).otherwise(midpoint(F.col("value"), F.col("after")))
    return swept.withColumn("slot", slot.cast("int")).where(here).groupBy("feature", cut.alias("cut")).agg(F.min("slot").alias("slot")).select("feature", "slot", "cut")


def binned_counts(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """Rows and ones of every threshold bin of each feature, and their running sums; bin b holds values that reach b of the cuts."""
    bins = sum((F.col("value") >= c).cast("int") for c in cuts)
    upto = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("bin", bins).groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    return counted.select("feature", "bin", "n", "ones", F.sum("n").over(upto).alias("n_upto"), F.sum("ones").over(upto).alias("ones_upto"))


def predict(tree: dict, vector: str) -> Column:
    """A tree as nested cases: {"feature", "threshold", "left", "right"} or {"action"}; left where the value is smaller."""
    if "action" in tree:
        return F.lit(tree["action"])
    return F.when(F.col(vector)[tree["feature"]] < tree["threshold"], predict(tree["left"], vector)).otherwise(predict(tree["right"], vector))


def grow(rows: DataFrame, row_id: str, vector: str, label: Column, depth: int, min_leaf: int = 1) -> DataFrame:
    """A greedy tree, level by level: (node, feature, threshold, impurity, left_rows). Node 1 is the root, children 2n and 2n + 1.

    All nodes of a level are split by one aggregation, so the number of jobs is the depth, not the number of nodes.
    """
    base = rows.select(F.col(row_id).alias("row_id"), label.alias("y"), F.col(vector).alias("vector"), F.lit(1).cast("long").alias("node"))
    levels = []
    for _ in range(depth):
        mixed = store(base.where(F.size("vector") > 0).groupBy("node").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).where("ones > 0 and ones < n").select("node"))
        even, tasks = dealt(base.join(mixed, "node", "left_semi"), "vector")
        long = even.select("node", "y", F.posexplode("vector").alias("feature", "value"))
        splits = store(best_split(value_counts(long, "node", tasks=tasks), "node", min_leaf=min_leaf))
        levels.append(splits)
        goes_left = F.get("vector", F.col("feature")) < F.col("threshold")
        base = base.join(splits.select("node", "feature", "threshold"), "node").select("row_id", "y", "vector", (2 * F.col("node") + F.when(goes_left, 0).otherwise(1)).alias("node"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def summary(splits: DataFrame, *by: str) -> DataFrame:
    """Nodes, depth and a fingerprint of trees given by their split rows (node, feature, threshold); node 1 is the root.

    The fingerprint is SHA-256 over the splits in order of node, a line for each; a tree's splits meet in one row.
    """
    line = F.concat_ws("|", F.col("node").cast("string"), F.col("feature").cast("string"), F.round(F.col("threshold") * 1e9).cast("long").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("node", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    found = [F.count("*").alias("splits"), (2 * F.count("*") + 1).alias("nodes"), (F.floor(F.log2(F.max("node"))) + 1).cast("int").alias("depth"), F.sha2(text.cast("binary"), 256).alias("fingerprint")]
    return splits.groupBy(*by).agg(*found) if by else splits.agg(*found)
