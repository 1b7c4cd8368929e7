"""Pareto fronts and supported frontiers of points in two axes, and theta joins for few points in more axes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts in which points are reduced before what is left of all parts is.
PARTS = 64


def pareto(points: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Points that no other is as good as on every axis and better on one (lower is better); equal points stay together.

    With two axes, each part of the points is reduced to its own front by a running minimum, and then the parts' fronts
    are: a front is far smaller than its points. With more axes it is a theta anti join, meant for aggregated points, of
    which there are few: one for each arm or method.
    """
    if len(axes) == 2:
        cost, loss = axes
        front = _front(_front(points.select(cost, loss).distinct().withColumn("part", F.pmod(F.xxhash64(cost), F.lit(PARTS))), cost, loss, "part"), cost, loss)
        return points.join(front, [cost, loss], "left_semi").select(*points.columns)
    others = points.select(*(F.col(c).alias(f"o_{c}") for c in (key, *axes)))
    as_good = reduce(lambda a, b: a & b, (F.col(f"o_{x}") <= F.col(x) for x in axes))
    better = reduce(lambda a, b: a | b, (F.col(f"o_{x}") < F.col(x) for x in axes))
    return points.join(others, (F.col(f"o_{key}") != F.col(key)) & as_good & better, "left_anti")


def _front(points: DataFrame, cost: str, loss: str, *by: str) -> DataFrame:
    """The front of each group: the least loss of each cost, where it is below that of all smaller costs."""
    least = points.groupBy(*by, cost).agg(F.min(loss).alias(loss))
    smaller = Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("before", F.min(loss).over(smaller)).where(f"before is null or {loss} < before").select(cost, loss)


def supported(points: DataFrame, key: str, cost: str, loss: str) -> DataFrame:
    """Points that minimise loss + price * cost for some price >= 0: the lower hull of the front, points on its edges
    included, and at price 0 all points of the least loss."""
    schema = points.select(cost, loss).schema

    def hull(table: pa.Table) -> pa.Table:
        """The convex chain of points that rise in cost and fall in loss; a turn is judged exactly if the values are integers."""
        rows = sorted(zip(table.column(cost).to_pylist(), table.column(loss).to_pylist(), strict=True))
        out: list[tuple] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (x - out[-2][0]) > (y - out[-2][1]) * (out[-1][0] - out[-2][0]):
                out.pop()
            out.append((x, y))
        return pa.table({cost: pa.array([x for x, _ in out], table.schema.field(cost).type), loss: pa.array([y for _, y in out], table.schema.field(loss).type)})

    front = pareto(points.select(cost, loss).distinct().withColumn(key, F.struct(cost, loss)), key, [cost, loss])
    parts = front.withColumn("part", F.pmod(F.xxhash64(cost), F.lit(PARTS))).groupBy("part").applyInArrow(lambda t: hull(t.select([cost, loss])), schema)
    corners = parts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: hull(t.select([cost, loss])), schema)
    free = points.join(F.broadcast(points.agg(F.min(loss).alias(loss))), loss).select(cost, loss)  # one row
    return points.join(corners.union(free).distinct(), [cost, loss], "left_semi").select(key, cost, loss)


def neighbours(front: DataFrame, key: str, cost: str, loss: str) -> DataFrame:
    """Each point of a front with the next dearer one and the cost of each unit of loss avoided. A front's points meet in one task."""
    order = Window.orderBy(cost, key)
    after = {c: F.lead(c).over(order) for c in (key, cost, loss)}
    steps = front.select(F.col(key).alias("cheap"), after[key].alias("dear"), F.round(F.try_divide(after[cost] - F.col(cost), F.col(loss) - after[loss]), 6).alias("per_unit"))
    return steps.where("dear is not null")


def break_even(better: dict[str, Column], premium: dict[str, Column], errors: int) -> list[Column]:
    """Status, cost of a percentage point, cost of an avoided error and exchange rate of a dearer, better method.

    Both are an estimate and its interval's low end: of the loss that the dearer method saves and of what it costs more.
    Prices are given only where both low ends are above 0.
    """
    stable = (better["low"] > 0) & (premium["low"] > 0)
    price = lambda c: F.round(F.when(stable, c), 6)
    return [
        F.when(stable, "STABLE").otherwise("UNSTABLE_ACCURACY_INCREMENT").alias("status"),
        price(premium["estimate"] / (100 * better["estimate"])).alias("per_point"),
        price(premium["estimate"] / (errors * better["estimate"])).alias("per_error"),
        price(better["estimate"] / premium["estimate"]).alias("rate"),
    ]
