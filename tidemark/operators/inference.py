"""Intervals and tests for equal-scenario means, and exact probabilities of what a bootstrap can not show."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.student import t_probability, t_quantile
from tidemark.operators.panel import KEYS


def weighted_hoeffding(cells: DataFrame, weight: Column, n: Column, *by: str, alpha: float = 0.05, family: int = 1, support: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """(by, radius): half-width of an interval for a weighted mean of strata that holds whatever the distribution in them.

    `cells` has a row a stratum. Weights are taken as shares of their sum; the interval is shared by a family of two-sided tests.
    """
    sums = cells.groupBy(*by).agg(F.sum(weight).alias("w"), F.sum(weight * weight / n).alias("spread")) if by else cells.agg(F.sum(weight).alias("w"), F.sum(weight * weight / n).alias("spread"))
    width = support[1] - support[0]
    return sums.select(*by, F.sqrt(0.5 * width * width * F.col("spread") / (F.col("w") * F.col("w")) * math.log(2 * family / alpha)).alias("radius"))


def welch_intervals(df: DataFrame, *values: str, alpha: float = 0.05, family: int | None = None, support: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """One row a contrast: estimate, se, freedom, statistic, p, adjusted (Holm), critical, low, high, fallback.

    The estimate is the mean of the scenarios' means. Welch and Satterthwaite's freedom gives p and the interval, which is
    shared by `family` contrasts (all of `values` unless told otherwise) and cut at `support`. Without any variance p is 1
    and the interval is Hoeffding's (`fallback`). Scenarios of one row have no variance of their own and count as 0.
    """
    family = family or len(values)
    long = df.unpivot(list(KEYS), list(values), "contrast", "x")
    spread = F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.coalesce(F.var_samp("x"), F.lit(0.0)))
    cells = long.where("x is not null").groupBy("contrast", "scenario").agg(F.avg("x").alias("m"), spread.alias("v"), F.count("x").alias("n"))
    part = F.col("v") / F.col("n")
    whole = cells.groupBy("contrast").agg(F.avg("m").alias("estimate"), F.sum(part).alias("s"), F.sum(F.try_divide(part * part, F.col("n") - 1)).alias("d"), F.count("*").alias("groups"), F.sum(1 / F.col("n")).alias("inverse"))
    radius = F.sqrt(0.5 * (support[1] - support[0]) ** 2 * F.col("inverse") / (F.col("groups") * F.col("groups")) * math.log(2 * family / alpha))
    whole = whole.withColumn("se", F.sqrt("s") / F.col("groups")).withColumn("freedom", F.try_divide(F.col("s") * F.col("s"), F.col("d"))).withColumn("statistic", F.try_divide(F.col("estimate"), F.col("se")))
    varies = F.col("se") > 0
    whole = whole.withColumn("p", F.when(varies, t_probability(F.col("statistic"), F.col("freedom"))).otherwise(1.0)).withColumn("critical", F.when(varies, t_quantile(F.lit(alpha / family), F.col("freedom"))))
    half = F.when(varies, F.col("critical") * F.col("se")).otherwise(radius)
    # A family is a handful of contrasts: each meets all others.
    others = whole.select(F.col("contrast").alias("other"), F.col("p").alias("other_p"))
    smaller = (F.col("other_p") < F.col("p")) | ((F.col("other_p") == F.col("p")) & (F.col("other") <= F.col("contrast")))
    places = whole.join(others, smaller).groupBy("contrast").agg(F.count("*").alias("place"))
    stepped = whole.join(places, "contrast").withColumn("step", F.least((family - F.col("place") + 1) * F.col("p"), F.lit(1.0)))
    below = stepped.select(F.col("place").alias("upto"), F.col("step").alias("lower_step"))
    adjusted = stepped.join(below, F.col("upto") <= F.col("place")).groupBy("contrast").agg(F.max("lower_step").alias("adjusted"))
    r = lambda c: F.round(c, 9)
    low, high = F.greatest(F.lit(support[0]), F.col("estimate") - half), F.least(F.lit(support[1]), F.col("estimate") + half)
    return stepped.join(adjusted, "contrast").select("contrast", *(r(c).alias(c) for c in ("estimate", "se", "freedom", "statistic", "p", "adjusted", "critical")), r(low).alias("low"), r(high).alias("high"), (~varies).alias("fallback"))


def no_event_probability(streams: Column, event: Column) -> Column:
    """The probability that none of so many independent streams has an event of this probability; exact for tiny ones."""
    return F.when((event == 1) & (streams > 0), 0.0).otherwise(F.exp(streams * F.log1p(-event)))


def zero_variance_mass(df: DataFrame, stratum: str, value: str, *by: str) -> DataFrame:
    """(by, strata, log_mass, mass): the probability that a bootstrap within each stratum draws equal values only, in all of them.

    Of a stratum of n values, all n draws fall on one value that occurs c times with probability (c / n)^n. Sums are taken
    relative to the commonest value and products as sums of logs, so that masses far below the smallest double still have
    a log. Null values are values of their own; a stratum of one value has mass 1.
    """
    counts = df.groupBy(*by, stratum, value).agg(F.count("*").alias("c"))
    whole = counts.groupBy(*by, F.col(stratum).alias("its_stratum")).agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    same = F.col(stratum).eqNullSafe(F.col("its_stratum"))
    renamed = whole.select(*(F.col(b).alias(f"its_{b}") for b in by), "its_stratum", "n", "most")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"its_{b}"))
    n = F.col("n").cast("double")
    joined = counts.join(renamed, same)
    per = joined.groupBy(*by, stratum, "n", "most").agg(F.sum(F.exp(n * F.log(F.col("c") / F.col("most")))).alias("relative"))
    log = n * F.log(F.col("most") / F.col("n")) + F.log("relative")
    out = per.groupBy(*by).agg(F.count("*").alias("strata"), F.sum(log).alias("log_mass")) if by else per.agg(F.count("*").alias("strata"), F.sum(log).alias("log_mass"))
    return out.select(*by, "strata", "log_mass", F.exp("log_mass").alias("mass"))
