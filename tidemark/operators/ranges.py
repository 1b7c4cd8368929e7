"""Places of all rows in one order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.stored import store


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `place` long: 1 for the first row in the order, and on without gaps.

    Rows are dealt to ranges of the order, sorted within each and written; a range's rows then take their places after
    those of the ranges before it. Only the ranges' sizes, one row a task, meet in one place. An order without ties is
    dealt evenly, however many rows share its first columns; rows tied in every column have any of their places.
    """
    laid = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # Fixed value: the id holds the task's number above 33 bits for the row.
    laid = laid.select("*", F.shiftrightunsigned("at", 33).alias("range"))
    sizes = laid.groupBy(F.col("range").alias("of_range")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("of_range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return laid.join(F.broadcast(sizes), F.col("range") == F.col("of_range")).select(*df.columns, place.alias("place"))
