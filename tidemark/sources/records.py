"""Nested JSON records: strict readers of lines and of record folders, flattening, canonical text, writers with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One record a line, with the schema's fields; a line that is no such JSON fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def line_violations(spark: SparkSession, path: str, schema: str, longest: int = 1 << 20) -> DataFrame:
    """(file, line, rule) of lines that are empty, too long, no record of the schema, or not in canonical form.

    A line is canonical if its fields are the schema's in order, without blanks between them, nulls left out.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    record = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    rules = {"empty": F.trim("line") == "", "long": F.length("line") > longest, "record": record.isNull(), "canonical": F.to_json(record) != F.col("line")}
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda r: r.isNotNull())
    return text.select("file", "line", F.explode(broken).alias("rule"))


def read_folder(spark: SparkSession, root: str, schema: str | T.StructType, names: str = "*.json") -> DataFrame:
    """A record a file, anywhere below `root`, of files whose name fits the pattern, with its file's path as `path`."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def file_digests(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below `root` whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_schedule(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A tab-separated schedule with a header and exactly the schema's columns; anything else fails the job."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def nested(path: str) -> Column:
    """A field by its path through structs and maps, null if something on the way is absent."""
    first, *rest = path.split(".")
    out = F.col(first)
    for step in rest:
        out = out.getItem(step)
    return out


def measured(path: str) -> Column:
    """A number by its path: null if it is absent, an error if it is below 0."""
    value = nested(path)
    return F.when(value < 0, F.raise_error(F.concat(F.lit(f"{path} is below 0: "), value.cast("string"))).cast("double")).otherwise(value)


def flattened(records: DataFrame, keys: list[str], by_arm: str, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """A row for each entry of a map column: the keys, `arm`, and each field by its path within the entry, divided by its unit."""
    rows = records.select(*keys, F.explode(by_arm).alias("arm", "entry"))
    return rows.select(*keys, "arm", *((nested(f"entry.{path}") / unit).alias(name) for name, (path, unit) in fields.items()))


def canonical_json(*columns: Column | str, names: list[str]) -> Column:
    """JSON text with fields in order of their names, without blanks; nulls are left out."""
    by_name = dict(zip(names, (F.col(c) if isinstance(c, str) else c for c in columns), strict=True))
    return F.to_json(F.struct(*(by_name[n].alias(n) for n in sorted(by_name))))


def record_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def write_chunks(df: DataFrame, path: str, rows: int) -> DataFrame:
    """Write compressed JSON lines of at most `rows` rows a file, and return the manifest (path, bytes, sha256) as written."""
    df.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", rows).json(path)
    return file_digests(df.sparkSession, path, "*.json.gz")


def chunk_differences(manifest: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(path, rule) where the files below `path` and a manifest of them differ: missing, unexpected or changed."""
    now = file_digests(spark, path, "*.json.gz").select("path", F.col("sha256").alias("now"))
    both = manifest.select("path", "sha256").join(now, "path", "full")
    rule = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", rule.alias("rule")).where("rule is not null")


def seed_schedule(scenarios: list[str], realisations: int, methods: list[str], spark: SparkSession) -> DataFrame:
    """(scenario, realisation, method, key): a row for each unit of a design, with the key of its address."""
    from tidemark.functions.addressing import key_from_address

    units = spark.range(realisations).select(F.explode(F.array(*map(F.lit, scenarios))).alias("scenario"), F.col("id").alias("realisation"))
    units = units.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    address = F.concat_ws("|", "scenario", F.concat(F.lit("r="), F.lpad(F.col("realisation").cast("string"), 3, "0")), "method")
    return units.withColumn("key", key_from_address(address))
