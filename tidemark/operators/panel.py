"""Panels of (scenario, realisation, arm): means, contrasts, moments, budgets.

The unit of replication is scenario and realisation; every mean over a panel is the mean of its scenarios' means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("scenario", "realisation")


def panel(rows: DataFrame, scenario: Column, realisation: Column, arm: Column, **metrics: Column) -> DataFrame:
    """One row for each scenario, realisation and arm, with each metric's aggregate."""
    keyed = rows.select(scenario.alias("scenario"), realisation.alias("realisation"), arm.alias("arm"), "*")
    return keyed.groupBy(*KEYS, "arm").agg(*(m.alias(name) for name, m in metrics.items()))


def equal_scenario_mean(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean of scenario means, with the number of scenarios and of rows."""
    cells = df.groupBy(*by, "scenario").agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return cells.groupBy(*by).agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("n_scenarios"), F.sum("n").alias("n"))


def scenario_summary(df: DataFrame, *values: str) -> DataFrame:
    return df.groupBy("scenario", "arm").agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values))


def arm_summary(df: DataFrame, *values: str) -> DataFrame:
    """Per arm and metric: equal-scenario mean, exact quantiles, and the range of scenario means."""
    long = df.unpivot([*KEYS, "arm"], list(values), "metric", "value")
    quantiles = long.groupBy("arm", "metric").agg(*(F.round(F.percentile("value", q), 6).alias(name) for name, q in (("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95))))
    means = long.groupBy("arm", "metric", "scenario").agg(F.avg("value").alias("m"))
    means = means.groupBy("arm", "metric").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("min_scenario"), F.round(F.max("m"), 6).alias("max_scenario"))
    return means.join(quantiles, ["arm", "metric"])


def paired(df: DataFrame, value: str, left, right) -> DataFrame:
    """left and right arms side by side for each scenario and realisation that has both, and their difference d."""
    one = lambda arm, name: F.max(F.when(F.col("arm") == arm, F.col(value))).alias(name)
    both = df.where(F.col("arm").isin(left, right)).groupBy(*KEYS).agg(one(left, "left"), one(right, "right"))
    return both.where("left is not null and right is not null").withColumn("d", F.col("left") - F.col("right"))


def stratified(df: DataFrame, value: str) -> DataFrame:
    """Equal-scenario mean and its stratified standard error: sqrt(sum of variance / n) / G."""
    cells = df.groupBy("scenario").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    return cells.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.sqrt(F.sum(F.col("v") / F.col("n"))) / F.count("*"), 8).alias("se"), F.count("*").alias("n_scenarios"))


def ratio(df: DataFrame, a: str, q: str) -> DataFrame:
    """Ratio of equal-scenario means of a and q, with the linearised standard error of z = a - theta * q."""
    cells = df.groupBy("scenario").agg(F.avg(a).alias("ma"), F.avg(q).alias("mq"), F.var_samp(a).alias("va"), F.var_samp(q).alias("vq"), F.covar_samp(a, q).alias("c"), F.count("*").alias("n"))
    whole = cells.agg(F.avg("ma").alias("ma"), F.avg("mq").alias("mq"), F.sum(F.col("va") / F.col("n")).alias("va"), F.sum(F.col("vq") / F.col("n")).alias("vq"), F.sum(F.col("c") / F.col("n")).alias("c"), F.count("*").alias("g"))
    theta = F.try_divide("ma", "mq")
    variance = F.greatest(F.col("va") - 2 * theta * F.col("c") + theta * theta * F.col("vq"), F.lit(0.0))
    return whole.select(F.round(theta, 6).alias("theta"), F.round(F.try_divide(F.sqrt(variance), F.col("g") * F.abs("mq")), 8).alias("se"))


def integer_moments(df: DataFrame, numerator: str, denominator: int) -> DataFrame:
    """Mean and standard error from exact integer sums of a numerator and its square."""
    x = F.col(numerator).cast("decimal(38,0)")
    cells = df.groupBy("scenario").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    mean = F.col("s").cast("double") / F.col("n")
    variance = (F.col("n") * F.col("ss") - F.col("s") * F.col("s")).cast("double") / (F.col("n") * (F.col("n") - 1))
    out = cells.select(mean.alias("m"), (variance / F.col("n")).alias("v"), "s", "ss")
    return out.agg(F.sum("s").cast("long").alias("total"), F.sum("ss").cast("long").alias("total_squares"), F.round(F.avg("m") / denominator, 6).alias("theta"), F.round(F.sqrt(F.sum("v")) / F.count("*") / denominator, 8).alias("se"))


def coverage(df: DataFrame, value: str, scheduled: str, *by: str) -> DataFrame:
    """Observed against scheduled slots of each scenario (and `by`); a mean only where every slot is observed."""
    cells = df.groupBy(*by, "scenario").agg(F.count(value).alias("observed"), F.max(scheduled).alias("scheduled"), F.round(F.avg(value), 6).alias("observed_mean"))
    return cells.withColumn("complete", F.col("observed") == F.col("scheduled")).withColumn("full_mean", F.when(F.col("complete"), F.col("observed_mean")))


def hard_budget(df: DataFrame, metrics: list[str], quantile: float) -> DataFrame:
    """Share of each arm's cells under the pooled quantile of every metric; equal weight to scenarios."""
    caps = df.agg(*(F.percentile(m, quantile).alias(f"cap_{m}") for m in metrics))
    fits = reduce(lambda a, b: a & b, (F.col(m) <= F.col(f"cap_{m}") for m in metrics))
    judged = df.crossJoin(F.broadcast(caps)).withColumn("fits", fits.cast("int"))  # the caps are one row
    return judged.groupBy("arm", "scenario").agg(F.avg("fits").alias("r")).groupBy("arm").agg(F.round(F.avg("r"), 6).alias("feasible"))


def minimum_rates(df: DataFrame, value: str, tolerance: float = 1e-12) -> DataFrame:
    """How often each arm has a cell's smallest value; ties share the credit."""
    cell = Window.partitionBy(*KEYS)
    tied = df.withColumn("tied", (F.abs(F.col(value) - F.min(value).over(cell)) <= tolerance).cast("int"))
    credit = tied.withColumn("credit", F.col("tied") / F.sum("tied").over(cell))
    return credit.groupBy("arm").agg(F.round(F.avg("credit"), 6).alias("rate"), F.sum("tied").alias("wins"))


def shadow_prices(df: DataFrame, loss: str, *resources: str) -> DataFrame:
    """For each pair of arms and resource: the price -dL/dR at which they break even, where positive."""
    means = df.groupBy("arm", "scenario").agg(*(F.avg(c).alias(c) for c in (loss, *resources))).groupBy("arm").agg(*(F.avg(c).alias(c) for c in (loss, *resources)))
    long = means.unpivot(["arm", loss], list(resources), "resource", "amount")
    a, b = long.alias("a"), long.alias("b")
    pairs = a.join(b, (F.col("a.resource") == F.col("b.resource")) & (F.col("a.arm") < F.col("b.arm")))
    price = -F.try_divide(F.col(f"a.{loss}") - F.col(f"b.{loss}"), F.col("a.amount") - F.col("b.amount"))
    return pairs.select(F.col("a.arm").alias("left_arm"), F.col("b.arm").alias("right_arm"), F.col("a.resource").alias("resource"), F.round(F.when(price > 0, price), 6).alias("price"))


def contingency(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of distinct (row, column, realisation) with zeros filled in."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def effective_freedom(df: DataFrame, *values: str) -> DataFrame:
    """(contrast, estimate, variance, freedom, groups, n): equal-scenario means, the variance of each, and Welch and
    Satterthwaite's degrees of freedom, null without variance. A scenario whose values are all the same has variance 0."""
    long = df.unpivot(list(KEYS), list(values), "contrast", "x")
    spread = F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.var_samp("x"))
    cells = long.groupBy("contrast", "scenario").agg(F.avg("x").alias("m"), spread.alias("v"), F.count("x").alias("n"))
    part = F.col("v") / F.col("n")
    whole = cells.groupBy("contrast").agg(F.avg("m").alias("estimate"), F.sum(part).alias("s"), F.sum(part * part / (F.col("n") - 1)).alias("d"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    squared = F.col("groups") * F.col("groups")
    return whole.select("contrast", F.round("estimate", 6).alias("estimate"), F.round(F.col("s") / squared, 10).alias("variance"), F.round(F.try_divide(F.col("s") * F.col("s"), F.col("d")), 6).alias("freedom"), "groups", "n")


def increments(df: DataFrame, left, right, *values: str) -> DataFrame:
    """Right arm minus left of each cell, a value null where either arm lacks it, and how many cells have it."""
    one = lambda arm, v: F.max(F.when(F.col("arm") == arm, F.col(v)))
    return df.where(F.col("arm").isin(left, right)).groupBy(*KEYS).agg(*((one(right, v) - one(left, v)).alias(v) for v in values))


def closure(df: DataFrame, value: str, first, middle, last) -> DataFrame:
    """Sums over all cells of the differences first - middle, middle - last and first - last of a value, and whether the two parts add up to the third."""
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col(value)))
    cells = df.groupBy(*KEYS).agg(one(first).alias("a"), one(middle).alias("b"), one(last).alias("c")).where("a is not null and b is not null and c is not null")
    sums = cells.agg(F.sum(F.col("a") - F.col("b")).alias("j1"), F.sum(F.col("b") - F.col("c")).alias("j2"), F.sum(F.col("a") - F.col("c")).alias("j_sum"), F.count("*").alias("cells"))
    return sums.withColumn("closed", F.col("j1") + F.col("j2") == F.col("j_sum"))


def eligibility(df: DataFrame, eligible: Column, *by: str) -> DataFrame:
    """Share of eligible rows of each group and overall (in a row with null keys and `overall` true)."""
    rows = df.select(*by, eligible.cast("int").alias("eligible"))
    found = rows.groupingSets([[F.col(c) for c in by], []], *by).agg((F.grouping_id() > 0).alias("overall"), F.count("*").alias("n"), F.sum("eligible").alias("eligible"), F.round(F.avg("eligible"), 6).alias("rate"))
    return found


def nested_mean(df: DataFrame, value: str, *levels: tuple[str, ...]) -> DataFrame:
    """Mean of means: by the first level's keys, then by each next one's; rows are no replicates of what they are nested in."""
    out = df
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(value).alias(value))
    return out.withColumn(value, F.round(value, 6))


def components(df: DataFrame, value: str, eligible: str, *by: str) -> DataFrame:
    """A, Q and their parts a stream: the mean of the value with 0 where not eligible, and the share that is eligible."""
    masked = F.when(F.col(eligible), F.col(value)).otherwise(0)
    return df.groupBy(*by).agg(F.round(F.avg(masked), 6).alias("a"), F.round(F.avg(F.col(eligible).cast("int")), 6).alias("q"), F.round(F.avg(F.when(F.col(eligible), F.col(value))), 6).alias("conditional"))


def ceiling(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Largest and total value of each group, and twice the largest: a bound set from a calibration."""
    return df.groupBy(*by).agg(F.max(value).alias("largest"), F.sum(value).alias("total"), (2 * F.max(value)).alias("bound"))
