"""Case expressions over intervals."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def practical_class(low: Column, high: Column, delta: float, otherwise: str = "INCONCLUSIVE") -> Column:
    """Whether an interval lies beyond delta, beyond -delta, or within both; the bounds themselves are within."""
    return F.when(low > delta, "BENEFICIAL").when(high < -delta, "HARMFUL").when((low >= -delta) & (high <= delta), "EQUIVALENT").otherwise(otherwise)


def direction(low: Column, high: Column) -> Column:
    """Which of two sides an interval of left minus right calls lower."""
    return F.when(high < 0, "LEFT_LOWER").when(low > 0, "RIGHT_LOWER").otherwise("UNRESOLVED")


def cancellation(first: Column, second: Column, total: Column) -> Column:
    """How two parts of a sum stand to each other: both classes given, and the sum's."""
    opposed = ((first == "BENEFICIAL") & (second == "HARMFUL")) | ((first == "HARMFUL") & (second == "BENEFICIAL"))
    return F.when(opposed & (total == "EQUIVALENT"), "CANCELLING").when(opposed, "OPPOSED").when(first == second, "AGREEING").otherwise("MIXED")


def dominance(directions: list[Column], left: Column, right: Column) -> Column:
    """The side that every axis calls lower, where all do; null where one is unresolved or they disagree."""
    every = lambda side: reduce(lambda a, b: a & b, (d == side for d in directions))
    return F.when(every("RIGHT_LOWER"), right).when(every("LEFT_LOWER"), left)


def hoeffding_radius(groups: Column, n: Column, alpha: float, family: int) -> Column:
    """Half-width of an interval for a mean of values in [-1, 1] that holds whatever their distribution, shared by a family of two-sided tests."""
    return F.sqrt(2 * F.lit(log(2 * family / alpha)) / (groups * n))
