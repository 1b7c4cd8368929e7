"""Registered queries of exact inference: t intervals, masses of degenerate bootstraps, unbiased draws, strict JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bits, splitmix
from tidemark.operators import inference
from tidemark.plans import registry as r
from tidemark.plans import studies
from tidemark.sources import strict_json

ALPHA, SUPPORT = 0.05, (-2000.0, 2000.0)

#: Fixed values of the generator, for the SQL.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: A bound that rejects every fourth word, and draws of each stream.
BOUND, DRAWS = (1 << 62) + (1 << 61) + 1, 8


def _streams(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return r._t(spark, d, "customer").select("c_custkey", (c * 1_000_003 - 7).alias("seed"), F.when(c % 5 == 0, c + 1).otherwise(F.lit(BOUND)).alias("bound"))


def _mass(spark: SparkSession, d: str) -> DataFrame:
    found = inference.zero_variance_mass(r._t(spark, d, "orders").withColumn("many", F.floor(F.col("o_totalprice") / 100_000)), "o_custkey", "many", "o_orderpriority")
    return found.select("o_orderpriority", "strata", F.round("log_mass", 6).alias("log_mass"), F.round(inference.no_event_probability(F.col("strata"), F.lit(0.001)), 9).alias("no_event"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as JSON, four in five of them with a fault or with keys out of order."""
    p, kind = F.col("props"), F.col("event_id") % 5
    nested = F.concat(F.lit('{"z": ['), p, F.lit('], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    text = F.when(kind == 0, p).when(kind == 1, nested).when(kind == 2, F.concat(F.lit('{"k": 0, '), F.substring(p, 2, 100))).when(kind == 3, F.concat(p, F.lit(" ]"))).otherwise(F.concat(F.lit("[NaN, "), p, F.lit("]")))
    return r._t(spark, d, "events").select("event_id", text.alias("text"))


#: Two-sided probability of x with v degrees of freedom: Simpson's rule from 0 on.
_P = """(1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * ({x}) / 6000
  * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(({x}) * i / 2000, 2) / {v}, -({v} + 1) / 2))))"""

QUERIES: dict[str, r.Query] = {
    "welch_intervals": lambda s, d: inference.welch_intervals(r._contrasts(s, d), *studies.METRICS, alpha=ALPHA, support=SUPPORT),
    "zero_variance_mass": _mass,
    "unbiased_indices": lambda s, d: splitmix.bounded_indices(_streams(s, d), ["c_custkey"], "seed", "bound", DRAWS),
    "double_bits": lambda s, d: r._t(s, d, "orders").select("o_orderkey", bits.double_hex(F.col("o_totalprice") / 7).alias("bits"), (bits.hex_double(bits.double_hex(F.col("o_totalprice") / 7)) == F.col("o_totalprice") / 7).alias("same")),
    "strict_json": lambda s, d: strict_json.violations(_documents(s, d), "text", "event_id"),
    "canonical_nested": lambda s, d: strict_json.canonical(_documents(s, d), "text", "event_id"),
}

ORACLE_SQL: dict[str, str] = {
    "welch_intervals": f"""WITH RECURSIVE {r.PANEL_SQL}, base AS ({studies._CONTRASTS_SQL}), long AS (UNPIVOT base ON {', '.join(studies.METRICS)} INTO NAME contrast VALUE x),
cells AS (SELECT contrast, scenario, avg(x) AS m, CASE WHEN min(x) = max(x) THEN 0 ELSE coalesce(var_samp(x), 0) END / count(x) AS v, count(x) AS n FROM long GROUP BY ALL),
w AS (SELECT contrast, avg(m) AS estimate, sqrt(sum(v)) / count(*) AS se, sum(v) * sum(v) / nullif(sum(v * v / nullif(n - 1, 0)), 0) AS df, avg(m) / (sqrt(sum(v)) / count(*)) AS t FROM cells GROUP BY contrast),
p AS (SELECT *, greatest({_P.format(v="df", x="abs(t)")}, 0) AS p FROM w),
halves(contrast, df, low, high, k) AS (
  SELECT contrast, df, 0::DOUBLE, 64::DOUBLE, 0 FROM w
  UNION ALL SELECT contrast, df, CASE WHEN above THEN (low + high) / 2 ELSE low END, CASE WHEN above THEN high ELSE (low + high) / 2 END, k + 1
  FROM (SELECT *, {_P.format(v="df", x="(low + high) / 2")} > {ALPHA / 3}::DOUBLE AS above FROM halves WHERE k < 50)),
c AS (SELECT contrast, high AS critical FROM halves WHERE k = 50),
steps AS (SELECT contrast, p, least((3 - row_number() OVER (ORDER BY p, contrast) + 1) * p, 1) AS step FROM p),
h AS (SELECT contrast, max(step) OVER (ORDER BY p, contrast ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM steps)
SELECT contrast, round(estimate, 9) AS estimate, round(se, 9) AS se, round(df, 9) AS freedom, round(t, 9) AS statistic, round(p, 9) AS p, round(adjusted, 9) AS adjusted, round(critical, 9) AS critical,
       round(greatest({SUPPORT[0]}, estimate - critical * se), 9) AS low, round(least({SUPPORT[1]}, estimate + critical * se), 9) AS high, false AS fallback
FROM p JOIN c USING (contrast) JOIN h USING (contrast)""",
    "zero_variance_mass": """WITH counts AS (SELECT o_orderpriority, o_custkey, floor(o_totalprice / 100000) AS many, count(*) AS c FROM orders GROUP BY ALL),
sized AS (SELECT *, sum(c) OVER p AS n, max(c) OVER p AS most FROM counts WINDOW p AS (PARTITION BY o_orderpriority, o_custkey)),
per AS (SELECT o_orderpriority, o_custkey, any_value(n) * ln(any_value(most) / any_value(n)) + ln(sum(exp(n * ln(c / most)))) AS log_mass FROM sized GROUP BY ALL)
SELECT o_orderpriority, count(*) AS strata, round(sum(log_mass), 6) AS log_mass, round(exp(count(*) * ln(0.999::DOUBLE)), 9) AS no_event FROM per GROUP BY ALL""",
    "unbiased_indices": f"""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey * 1000003 - 7 < 0 THEN (18446744073709551616::HUGEINT + c_custkey * 1000003 - 7)::UHUGEINT ELSE (c_custkey * 1000003 - 7)::UHUGEINT END AS seed, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE {BOUND} END::UHUGEINT AS n FROM customer),
a AS (SELECT *, (seed + (k::UHUGEINT * {STEP}::UHUGEINT)) % 18446744073709551616::UHUGEINT AS z FROM s, range(1, 65) t(k)),
b AS (SELECT * REPLACE ((xor(z, z >> 30) * {FIRST}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM a),
c AS (SELECT * REPLACE ((xor(z, z >> 27) * {SECOND}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM b),
d AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1 AS draw FROM d WHERE z >= 18446744073709551616::UHUGEINT % n)
SELECT c_custkey, draw, (z % n)::BIGINT AS index FROM e WHERE draw < {DRAWS}""",
    "double_bits": "SELECT o_orderkey, lpad(lower(hex((o_totalprice / 7)::DOUBLE::BIT::UBIGINT)), 16, '0') AS bits, true AS same FROM orders",
    "strict_json": "SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'repeated_key' WHEN 3 THEN 'trailing_text' ELSE 'not_a_number' END AS rule FROM events WHERE event_id % 5 >= 2",
    "canonical_nested": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN replace(props, ' ', '') ELSE '{"a":' || event_id || ',"z":[' || replace(props, ' ', '') || ']}' END AS canonical FROM events WHERE event_id % 5 < 2""",
}
