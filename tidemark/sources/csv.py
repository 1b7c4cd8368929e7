"""Strict readers of CSV, TSV and JSON lines, and writers that refuse empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A plain decimal number.
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """RFC 4180 text with a header, all columns as strings; ragged rows fail the job."""
    header = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def numeric_violations(df: DataFrame, target: str, labels: dict[str, int]) -> DataFrame:
    """(column, value, n): cells that are blank, no finite decimal number, or no known label."""
    features = [c for c in df.columns if c != target]
    long = df.unpivot([], features, "column", "value")
    finite = F.coalesce(F.col("value").rlike(DECIMAL) & (F.abs(F.expr("try_cast(value AS double)")) < float("inf")), F.lit(False))
    bad = long.where(~finite)
    unknown = df.where(~F.coalesce(F.col(target).isin(list(labels)), F.lit(False))).select(F.lit(target).alias("column"), F.col(target).alias("value"))
    return bad.union(unknown).groupBy("column", "value").agg(F.count("*").alias("n"))


def read_numeric(spark: SparkSession, path: str, target: str, labels: dict[str, int]) -> DataFrame:
    """Features as doubles and the target as its label; any violation raises with the first offender."""
    df = read_strings(spark, path)
    first = numeric_violations(df, target, labels).orderBy("column", "value").first()
    if first:
        raise ValueError(f"{path}: column {first['column']} holds {first['value']!r}")
    label = F.lit(None).cast("int")
    for name, value in labels.items():
        label = F.when(F.col(target) == name, value).otherwise(label)
    return df.select(*(F.col(c).cast("double").alias(c) for c in df.columns if c != target), label.alias("y"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write with a header; Spark's commit protocol makes it whole or absent. An empty table is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def two_tapes(features: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Features joined with labels kept apart from them; a row without its partner on either side fails the job."""
    both = features.withColumn("has_x", F.lit(True)).join(labels.withColumn("has_y", F.lit(True)), list(keys), "full")
    whole = F.col("has_x").isNotNull() & F.col("has_y").isNotNull()
    checked = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a row lacks its features or its label")).cast("boolean"))
    return both.withColumn("whole", checked).where("whole").drop("has_x", "has_y", "whole")
