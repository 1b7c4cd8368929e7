"""Registered queries: the operators on the driver's tables, with production parameters and no filters of convenience."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import addressing, classify
from tidemark.functions import scenarios as sc
from tidemark.operators import checks, frontier, lineage, ordered, panel, resample, trees

Query = Callable[[SparkSession, str], DataFrame]

#: Replicates of the registered bootstraps, and the levels of a family of three tests and of one interval.
REPLICATES, FAMILY_LEVEL, LEVEL = 9999, 1 - 0.05 / 3, 0.95


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a panel: integer sums of cents and hundredths, so that means don't depend on order."""
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return panel.panel(
        _t(spark, d, "lineitem"), F.concat_ws("-", "l_returnflag", "l_linestatus"), F.col("l_suppkey"), F.col("l_linenumber") % 3,
        n_rows=F.count("*"), quantity=F.sum(F.col("l_quantity").cast("long")), discount=hundredths("l_discount"), tax=hundredths("l_tax"),
    )


PANEL_SQL = """panel AS (
  SELECT l_returnflag || '-' || l_linestatus AS scenario, l_suppkey AS realisation, l_linenumber % 3 AS arm, count(*) AS n_rows,
         sum(l_quantity::BIGINT)::BIGINT AS quantity, sum(round(l_discount * 100)::BIGINT)::BIGINT AS discount, sum(round(l_tax * 100)::BIGINT)::BIGINT AS tax
  FROM lineitem GROUP BY ALL)"""

PAIRED_SQL = PANEL_SQL + """,
paired AS (
  SELECT scenario, realisation, "left", "right", "left" - "right" AS d
  FROM (SELECT scenario, realisation, max(discount) FILTER (arm = 0) AS "left", max(discount) FILTER (arm = 1) AS "right"
        FROM panel GROUP BY ALL) WHERE "left" IS NOT NULL AND "right" IS NOT NULL)"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return panel.paired(_panel(spark, d), "discount", 0, 1)


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", F.col("event_type").isin("purchase", "click").cast("int").alias("y"))
    return ordered.sequenced(events, "user_id", "ts", "event_id")


EVENTS_SQL = """events_in_order AS (
  SELECT user_id, ts, event_id, event_type, value, (event_type IN ('purchase', 'click'))::INTEGER AS y,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
  FROM events)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as points: lines, total quantity, total discount."""
    return _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum(F.col("l_quantity").cast("long")).alias("cost"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("loss"))


POINTS_SQL = """points AS (
  SELECT l_suppkey AS supplier, sum(l_quantity::BIGINT)::BIGINT AS cost, sum(round(l_tax * 100)::BIGINT)::BIGINT AS loss FROM lineitem GROUP BY ALL)"""


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records whose parents are at a half and a third of their number."""
    c = F.col("c_custkey")
    parents = F.array_distinct(F.filter(F.array((c / 2).cast("long"), (c / 3).cast("long")), lambda p: (p >= 1) & (p < c)))
    return _t(spark, d, "customer").where("c_custkey >= 1").select(c.alias("id"), "c_mktsegment", parents.alias("parents"))


LINEAGE_SQL = """edges AS (
  SELECT DISTINCT c_custkey AS child, p AS parent
  FROM (SELECT c_custkey, unnest([c_custkey // 2, c_custkey // 3]) AS p FROM customer WHERE c_custkey >= 1) WHERE p >= 1 AND p < c_custkey)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return trees.long_features(trees.dealt(_t(spark, d, "embeddings"), "embedding")[0], "vec_id", "embedding", (F.col("label") < 5).cast("int")).withColumn("value", F.col("value").cast("double"))


FEATURES_SQL = """long AS (
  SELECT vec_id AS row_id, (label < 5)::INTEGER AS y, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"""

CUTS = [-0.2, -0.1, 0.0, 0.1, 0.2]


def _stream(spark: SparkSession, d: str, partition: str = "DEV", realisations: int = 3) -> DataFrame:
    """Rows of drift streams addressed by orders: scenario, realisation and row number follow from the order's number."""
    names = sc.scenarios()
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    rows = _t(spark, d, "orders").select("o_orderkey", pick.alias("scenario"), (F.col("o_orderkey") % 26_000 + 1).alias("t"))
    return rows.withColumn("key", sc.stream_key(F.col("scenario"), F.col("o_orderkey") % realisations, partition))


def _addr_bits(spark: SparkSession, d: str) -> DataFrame:
    address = addressing.draw_address(F.lit("0123456789abcdef"), F.lit("FEATURE"), F.col("o_orderkey"), F.lit(0))
    bits = addressing.top_53_bits(address)
    return _t(spark, d, "orders").select("o_orderkey", addressing.key_from_address(address).alias("key"), bits.alias("bits"), F.round(addressing.open_uniform(bits), 12).alias("u"))


#: Fixed values below: the tag and form of a draw's address and of a stream's, as in `functions.addressing` and `functions.scenarios`.


def _bits_sql(role: str, index: str, draw: int | str, key: str = "'0123456789abcdef'") -> str:
    return f"""(('0x' || substr(sha256('["DT-P9-DRAW-v1","' || {key} || '","{role}",' || {index} || ',{draw}]'), 1, 16))::UBIGINT >> 11)"""


def _u_sql(role: str, index: str, draw: int | str, key: str = "'0123456789abcdef'") -> str:
    return f"least(({_bits_sql(role, index, draw, key)}::DOUBLE + 0.5) / 9007199254740992.0, 1 - 1.1102230246251565e-16)"


def _stream_labels(spark: SparkSession, d: str, partition: str = "DEV", realisations: int = 3) -> DataFrame:
    return sc.stream_rows(_stream(spark, d, partition, realisations)).select("o_orderkey", "scenario", "key", "t", "concept", *(F.round(F.col("x")[j], 9).alias(f"x{j}") for j in range(8)), "clean", "y")


#: Which concept holds when, for the SQL: drift, first and last row, rows over which it comes in (before, the one before it may still hold), concept.
PHASES = [
    ("STATIONARY", 1, 26_000, 0, 0),
    *(("ABRUPT", first, last, 0, k) for k, (first, last) in enumerate([(1, 10_000), (10_001, 20_000), (20_001, 26_000)])),
    *(("RECURRENT", first, last, 0, k % 2) for k, (first, last) in enumerate([(1, 10_000), (10_001, 20_000), (20_001, 26_000)])),
    *(("GRADUAL", first, last, 2_000 * (k > 0), k) for k, (first, last) in enumerate([(1, 10_000), (10_001, 20_000), (20_001, 26_000)])),
]


def _stream_sql(address: str = "'DT-P9-v1|DEV|' || name || '|r=0' || o_orderkey % 3") -> str:
    """Rows of the streams from tables: the phases of each drift joined by range, sizes by name, labels by a product of lists."""
    names = ", ".join(f"'{n}'" for n in sc.scenarios())
    phases = ", ".join(map(str, PHASES))
    u = lambda role, draw: _u_sql(role, "t", draw, "key")
    pairs = ", ".join(f"{{'u': {u(f'features:{j}', 0)}, 'v': {u(f'features:{j}', 1)}}}" for j in range(8))
    return f"""
WITH phases(drift, first_row, last_row, ramp, concept) AS (VALUES {phases}),
sizes(severity, size) AS (VALUES ('NONE', 0::DOUBLE), ('MILD', 0.1::DOUBLE), ('SEVERE', 0.25::DOUBLE)),
asked AS (SELECT o_orderkey, o_orderkey % 26000 + 1 AS t, string_split(name, '-') AS named, name AS scenario, substr(sha256({address}), 1, 16) AS key
  FROM orders JOIN (SELECT unnest([{names}]) AS name, unnest(range(14)) AS nth) ON nth = o_orderkey % 14),
drawn AS (SELECT *, {u('mixture', 0)} AS mixture, {u('label_noise', 0)} AS noise, [{pairs}] AS draws FROM asked),
rowed AS (
  SELECT o_orderkey, scenario, key, t, noise, size, named[1] AS family, list_transform(draws, lambda d: CASE WHEN named[1] = 'OBLIQUE' THEN sqrt(-2 * ln(d.u)) * cos(2 * pi() * d.v) ELSE d.u END) AS x,
         p.concept - (t < first_row + ramp AND mixture >= (t - first_row + 1)::DOUBLE / ramp)::INTEGER AS concept
  FROM drawn JOIN phases p ON drift = named[2] AND t BETWEEN first_row AND last_row JOIN sizes ON severity = named[3]),
halved AS (SELECT *, (x[1] >= 0.5)::INTEGER AS half, concept * pi() * size AS turn FROM rowed),
labelled AS (
  SELECT *, CASE WHEN family = 'OBLIQUE' THEN list_inner_product(x, list_transform(range(8), lambda j: CASE WHEN j < 4 THEN cos(turn) ELSE sin(turn) END / 2)) >= 0
                 ELSE (x[2 + half] - size * (concept > half)::INTEGER + 1) % 1 < 0.5 END::INTEGER AS clean FROM halved)
SELECT o_orderkey, scenario, key, t, concept, {', '.join(f'round(x[{j + 1}], 9) AS x{j}' for j in range(8))}, clean, abs(clean - (noise < 0.1)::INTEGER) AS y FROM labelled"""


def _replicates_sql(columns: dict[str, str], source: str, name: str, rows: str) -> str:
    """Common tables: places, draws and the moments of every replicate and of the whole, for long (contrast, x) columns."""
    union = " UNION ALL ".join(f"SELECT scenario, realisation, place, '{c}' AS contrast, {x}::BIGINT AS x FROM placed" for c, x in columns.items())
    return f"""{source},
base AS ({rows}),
placed AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY realisation) - 1 AS place FROM base),
sizes AS (SELECT scenario, count(*) AS n FROM placed GROUP BY ALL),
tape AS (
  SELECT b, scenario, (('0x' || substr(sha256('{name}|' || b || '|' || scenario || '|' || i), 1, 16))::UBIGINT >> 11)::BIGINT % n AS place
  FROM (SELECT scenario, n, b, unnest(range(n)) AS i FROM sizes, range({REPLICATES}) r(b))),
times AS (SELECT b, scenario, place, count(*) AS times FROM tape GROUP BY ALL),
long AS ({union}),
cells AS (
  SELECT contrast, b, scenario, sum(times)::BIGINT AS n, sum(times * x)::BIGINT AS s, sum(times * x * x)::BIGINT AS ss
  FROM long JOIN times USING (scenario, place) GROUP BY ALL),
reps AS (
  SELECT contrast, b, avg(s / n) AS theta, sqrt(sum((n * ss - s * s) / (n * (n - 1)) / n)) / count(*) AS se FROM cells GROUP BY ALL),
whole AS (
  SELECT contrast, avg(s / n) AS estimate, sqrt(sum((n * ss - s * s) / (n * (n - 1)) / n)) / count(*) AS se_0
  FROM (SELECT contrast, scenario, count(*) AS n, sum(x)::BIGINT AS s, sum(x * x)::BIGINT AS ss FROM long GROUP BY ALL) GROUP BY ALL)"""


def _holm(spark: SparkSession, d: str) -> DataFrame:
    """Each scenario's paired difference as a test of its own, by the tail bound min(1, 1 / t^2)."""
    cells = _paired(spark, d).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    t2 = (F.col("s") * F.col("s") * (F.col("n") - 1)) / F.nullif(F.col("n") * F.col("ss") - F.col("s") * F.col("s"), F.lit(0))
    tests = cells.select("scenario", F.round(F.coalesce(F.least(1 / F.nullif(t2, F.lit(0.0)), F.lit(1.0)), F.lit(1.0)), 9).alias("p"))
    return resample.holm(tests.withColumn("family", F.substring("scenario", 1, 1)), "scenario", "p", "family")


def _quality_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 600).cast("int").alias("pred")).join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return ordered.confusion(rows, "quality", "pred", "lang")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    slots = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("realisation"))
    n = slots.agg(F.count("*").alias("scheduled"))
    seen = _panel(spark, d).withColumn("observed", F.when(F.col("discount") > 20, F.col("discount")))
    return panel.coverage(seen.crossJoin(F.broadcast(n)), "observed", "scheduled", "arm")  # one row


def _mechanism(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.regression import fixed_effects

    return fixed_effects(_panel(spark, d), "discount", ["quantity", "tax", "n_rows"], "scenario")


QUERIES: dict[str, Query] = {
    "panel_equal_scenario_mean": lambda s, d: panel.equal_scenario_mean(_panel(s, d), "discount", "arm"),
    "panel_scenario_summary": lambda s, d: panel.scenario_summary(_panel(s, d), "quantity", "discount", "tax"),
    "panel_arm_summary": lambda s, d: panel.arm_summary(_panel(s, d), "quantity", "discount", "tax"),
    "panel_paired_contrast": _paired,
    "panel_stratified_se": lambda s, d: panel.stratified(_paired(s, d), "d"),
    "panel_ratio_estimator": lambda s, d: panel.ratio(_panel(s, d), "discount", "n_rows"),
    "panel_integer_moments": lambda s, d: panel.integer_moments(_paired(s, d), "d", 100),
    "panel_hard_budget": lambda s, d: panel.hard_budget(_panel(s, d), ["quantity", "discount"], 0.5),
    "panel_min_rates": lambda s, d: panel.minimum_rates(_panel(s, d), "discount"),
    "panel_shadow_price": lambda s, d: panel.shadow_prices(_panel(s, d), "discount", "quantity", "tax"),
    "coverage_cluster_summary": _coverage,
    "status_frequency": lambda s, d: _t(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")),
    "segment_contingency": lambda s, d: panel.contingency(_t(s, d, "events").select("event_type", (F.col("user_id") % 3).alias("host"), "user_id").distinct().select("event_type", F.concat(F.lit("host_"), F.col("host").cast("string")).alias("host")), "event_type", "host", ["host_0", "host_1", "host_2"]),
    "pareto_front": lambda s, d: frontier.pareto(_points(s, d), "supplier", ["cost", "loss"]),
    "supported_frontier": lambda s, d: frontier.supported(_points(s, d), "supplier", "cost", "loss"),
    "frontier_neighbours": lambda s, d: frontier.neighbours(frontier.pareto(_points(s, d), "supplier", ["cost", "loss"]), "supplier", "cost", "loss"),
    "confusion_metrics": _quality_confusion,
    "horizon_metrics": lambda s, d: ordered.horizon_losses(ordered.last_label(_events(s, d), "user_id"), "user_id", [5, 20, 50], F.col("y") != F.col("pred")),
    "segment_metrics": lambda s, d: _segments(s, d),
    "preq_last_label": lambda s, d: ordered.last_label(_events(s, d), "user_id").groupBy("user_id").agg(F.count_if(F.col("y") != F.col("pred")).alias("losses"), F.count("*").alias("n")),
    "preq_prefix_majority": lambda s, d: ordered.prefix_majority(_events(s, d), "user_id").groupBy("user_id").agg(F.count_if(F.col("y") != F.col("pred")).alias("losses"), F.count("*").alias("n")),
    "preq_recent_window": lambda s, d: ordered.recent_loss(ordered.last_label(_events(s, d), "user_id"), "user_id", 20, F.col("y") != F.col("pred")).select("user_id", "event_id", "recent_misses", "recent_rows"),
    "cum_error_curve": lambda s, d: ordered.error_curve(ordered.last_label(_events(s, d), "user_id"), "user_id", 10, F.col("y") != F.col("pred")).select("user_id", "seq", "misses"),
    "failure_latch": lambda s, d: ordered.latched(_events(s, d), "user_id", F.col("event_type") == "error").groupBy("user_id").agg(F.sum("failed").alias("failed_rows"), F.count_if((F.col("failed") == 1) | (F.col("y") == 0)).alias("loss")),
    "chronology_violations": lambda s, d: ordered.chronology_violations(_t(s, d, "events"), "user_id", "event_id", "ts", "24 HOURS"),
    "cart_best_split": lambda s, d: trees.best_split(trees.value_counts(_features(s, d)), min_leaf=5),
    "candidate_thresholds": lambda s, d: trees.candidate_thresholds(_features(s, d), 32),
    "cart_threshold_bins": lambda s, d: trees.binned_counts(_features(s, d), CUTS),
    "cart_greedy_tree": lambda s, d: trees.grow(_t(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding", (F.col("label") < 5).cast("int"), depth=3, min_leaf=5),
    "addr_uniform": _addr_bits,
    "stream_labels": _stream_labels,
    "conf_stream_labels": lambda s, d: _stream_labels(s, d, "CONF", 320),
    "bootstrap_t_mean": lambda s, d: resample.bootstrap_t(_paired(s, d), "d", REPLICATES, "H1", FAMILY_LEVEL),
    "bootstrap_percentile_ci": lambda s, d: resample.percentile_interval(_paired(s, d), "d", REPLICATES, "H1"),
    "bootstrap_maxt": lambda s, d: resample.max_t(_contrasts(s, d), ["discount", "quantity", "tax"], REPLICATES, "MAXT").withColumn("direction", classify.direction(F.col("low"), F.col("high"))),
    "practical_class": lambda s, d: resample.percentile_interval(_paired(s, d), "d", REPLICATES, "H1").select("low", "high", classify.practical_class(F.col("low"), F.col("high"), 5.0).alias("class")),
    "holm_stepdown": _holm,
    "lineage_ancestors": lambda s, d: lineage.ancestors(lineage.edges(_lineage(s, d))),
    "lineage_depth": lambda s, d: lineage.depths(lineage.edges(_lineage(s, d)), _lineage(s, d).where(F.size("parents") == 0).select(F.col("id").alias("node"))),
    "lineage_rollup": lambda s, d: lineage.rollup(_lineage(s, d), "c_mktsegment"),
    "population_diversity": lambda s, d: checks.diversity(_t(s, d, "lineitem"), F.col("l_partkey"), "l_suppkey"),
    "multiset_digest": lambda s, d: checks.multiset_digest(_t(s, d, "lineitem"), F.col("l_partkey"), "l_suppkey"),
    "order_digest_root": lambda s, d: checks.order_digest(_t(s, d, "orders"), "o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus"), "o_custkey"),
    "key_completeness": lambda s, d: checks.key_differences(_t(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), _t(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("status")), ["key", "status"]),
    "duplicate_keys": lambda s, d: checks.duplicate_keys(_t(s, d, "lineitem"), ["l_orderkey", "l_partkey"]),
    "one_hot": lambda s, d: checks.encoded(_t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}),
    "mechanism_ols": _mechanism,
}


def _contrasts(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    out = None
    for value in ("discount", "quantity", "tax"):
        one = panel.paired(p, value, 0, 1).select("scenario", "realisation", F.col("d").alias(value))
        out = one if out is None else out.join(one, ["scenario", "realisation"])
    return out


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.last_label(_events(spark, d), "user_id")
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "user_id").withColumn("segment", ordered.segment(F.col("seq"), F.col("n"), 4))
    return rows.groupBy("user_id", "segment").agg(F.count_if(F.col("y") != F.col("pred")).alias("losses"), F.count("*").alias("n"))


_LAST = f"""{EVENTS_SQL},
scored AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY user_id ORDER BY seq), 0) AS pred FROM events_in_order)"""
_FRONT = f"""{POINTS_SQL},
front AS (SELECT * FROM points p WHERE NOT EXISTS (
  SELECT 1 FROM points o WHERE o.supplier <> p.supplier AND o.cost <= p.cost AND o.loss <= p.loss AND (o.cost < p.cost OR o.loss < p.loss)))"""


def _greedy_sql(depth: int, min_leaf: int) -> str:
    """The greedy tree level by level: rows at a node, the sweep of each of its features, the best cut, and the rows of the next level."""
    sql, base = [], "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (label < 5)::INTEGER AS y, 1::BIGINT AS node FROM embeddings"
    for k in range(depth):
        sql.append(f"""r{k} AS ({base}),
l{k} AS (SELECT node, y, generate_subscripts(v, 1) - 1 AS feature, unnest(v) AS value FROM r{k} WHERE node IN (SELECT node FROM r{k} GROUP BY node HAVING sum(y) > 0 AND sum(y) < count(*))),
v{k} AS (SELECT node, feature, value, count(*) AS n, sum(y)::BIGINT AS ones FROM l{k} GROUP BY ALL),
w{k} AS (SELECT node, feature, value, sum(n) OVER o AS nl, sum(ones) OVER o AS ol, sum(n) OVER p AS nt, sum(ones) OVER p AS ot, lead(value) OVER o AS after FROM v{k} WINDOW o AS (PARTITION BY node, feature ORDER BY value), p AS (PARTITION BY node, feature)),
i{k} AS (SELECT *, round((2 * ol * (nl - ol) / nl + 2 * (ot - ol) * ((nt - nl) - (ot - ol)) / (nt - nl)) / nt, 9) AS impurity FROM w{k} WHERE after IS NOT NULL AND nl >= {min_leaf} AND nt - nl >= {min_leaf}),
s{k} AS (SELECT node, feature::INTEGER AS feature, CASE WHEN value / 2 + after / 2 > value AND value / 2 + after / 2 <= after THEN value / 2 + after / 2 ELSE after END AS threshold, impurity, nl::BIGINT AS left_rows
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY impurity, feature, value) AS best FROM i{k}) WHERE best = 1)""")
        base = f"SELECT vec_id, v, y, 2 * node + (NOT v[feature + 1] < threshold)::BIGINT AS node FROM r{k} JOIN s{k} USING (node)"
    return "WITH " + ",\n".join(sql) + "\n" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(depth))


_H1 = _replicates_sql({"d": "d"}, PAIRED_SQL, "H1", "SELECT * FROM paired")
#: Order statistics of REPLICATES sorted values: 2.5 % from both ends, and the quantiles of the pivots.
LOW, HIGH, CRITICAL, HIGHER = 250, 9750, 9834, 9500
_CI = f"round(list_sort(list(theta))[{LOW}], 6) AS low, round(list_sort(list(theta))[{HIGH}], 6) AS high"

ORACLE_SQL: dict[str, str] = {
    "panel_equal_scenario_mean": f"WITH {PANEL_SQL} SELECT arm, round(avg(m), 6) AS mean, count(*) AS n_scenarios, sum(n)::BIGINT AS n FROM (SELECT arm, scenario, avg(discount) AS m, count(discount) AS n FROM panel GROUP BY ALL) GROUP BY arm",
    "panel_scenario_summary": f"WITH {PANEL_SQL} SELECT scenario, arm, count(*) AS n, round(avg(quantity), 6) AS mean_quantity, round(avg(discount), 6) AS mean_discount, round(avg(tax), 6) AS mean_tax FROM panel GROUP BY ALL",
    "panel_arm_summary": f"""WITH {PANEL_SQL},
long AS (UNPIVOT panel ON quantity, discount, tax INTO NAME metric VALUE value),
q AS (SELECT arm, metric, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95 FROM long GROUP BY ALL),
m AS (SELECT arm, metric, round(avg(m), 6) AS mean, round(min(m), 6) AS min_scenario, round(max(m), 6) AS max_scenario FROM (SELECT arm, metric, scenario, avg(value) AS m FROM long GROUP BY ALL) GROUP BY ALL)
SELECT * FROM m JOIN q USING (arm, metric)""",
    "panel_paired_contrast": f"WITH {PAIRED_SQL} SELECT * FROM paired",
    "panel_stratified_se": f"WITH {PAIRED_SQL} SELECT round(avg(m), 6) AS mean, round(sqrt(sum(v / n)) / count(*), 8) AS se, count(*) AS n_scenarios FROM (SELECT scenario, avg(d) AS m, var_samp(d) AS v, count(d) AS n FROM paired GROUP BY ALL)",
    "panel_ratio_estimator": f"""WITH {PANEL_SQL},
cells AS (SELECT scenario, avg(discount) AS ma, avg(n_rows) AS mq, var_samp(discount) AS va, var_samp(n_rows) AS vq, covar_samp(discount, n_rows) AS c, count(*) AS n FROM panel GROUP BY ALL),
w AS (SELECT avg(ma) AS ma, avg(mq) AS mq, sum(va / n) AS va, sum(vq / n) AS vq, sum(c / n) AS c, count(*) AS g FROM cells)
SELECT round(ma / mq, 6) AS theta, round(sqrt(greatest(va - 2 * (ma / mq) * c + (ma / mq) * (ma / mq) * vq, 0)) / (g * abs(mq)), 8) AS se FROM w""",
    "panel_integer_moments": f"""WITH {PAIRED_SQL},
cells AS (SELECT scenario, count(*) AS n, sum(d)::BIGINT AS s, sum(d * d)::BIGINT AS ss FROM paired GROUP BY ALL)
SELECT sum(s)::BIGINT AS total, sum(ss)::BIGINT AS total_squares, round(avg(s / n / 100), 6) AS theta, round(sqrt(sum((n * ss - s * s) / (n * (n - 1)) / n)) / count(*) / 100, 8) AS se FROM cells""",
    "panel_hard_budget": f"""WITH {PANEL_SQL}, caps AS (SELECT quantile_cont(quantity, 0.5) AS q, quantile_cont(discount, 0.5) AS c FROM panel)
SELECT arm, round(avg(r), 6) AS feasible FROM (SELECT arm, scenario, avg((quantity <= q AND discount <= c)::INTEGER) AS r FROM panel, caps GROUP BY ALL) GROUP BY arm""",
    "panel_min_rates": f"""WITH {PANEL_SQL}, t AS (SELECT *, (abs(discount - min(discount) OVER (PARTITION BY scenario, realisation)) <= 1e-12)::INTEGER AS tied FROM panel)
SELECT arm, round(avg(credit), 6) AS rate, sum(tied)::BIGINT AS wins FROM (SELECT arm, tied, tied / sum(tied) OVER (PARTITION BY scenario, realisation) AS credit FROM t) GROUP BY arm""",
    "panel_shadow_price": f"""WITH {PANEL_SQL},
m AS (SELECT arm, avg(discount) AS loss, avg(quantity) AS quantity, avg(tax) AS tax FROM (SELECT arm, scenario, avg(discount) AS discount, avg(quantity) AS quantity, avg(tax) AS tax FROM panel GROUP BY ALL) GROUP BY arm),
long AS (SELECT arm, loss, 'quantity' AS resource, quantity AS amount FROM m UNION ALL SELECT arm, loss, 'tax', tax FROM m)
SELECT a.arm AS left_arm, b.arm AS right_arm, a.resource, round(CASE WHEN -(a.loss - b.loss) / nullif(a.amount - b.amount, 0) > 0 THEN -(a.loss - b.loss) / nullif(a.amount - b.amount, 0) END, 6) AS price
FROM long a JOIN long b ON a.resource = b.resource AND a.arm < b.arm""",
    "coverage_cluster_summary": f"""WITH {PANEL_SQL},
c AS (SELECT arm, scenario, count(*) FILTER (discount > 20) AS observed, (SELECT count(*) FROM supplier) AS scheduled, round(avg(discount) FILTER (discount > 20), 6) AS observed_mean FROM panel GROUP BY arm, scenario)
SELECT *, observed = scheduled AS complete, CASE WHEN observed = scheduled THEN observed_mean END AS full_mean FROM c""",
    "status_frequency": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "segment_contingency": "SELECT event_type, count(DISTINCT user_id) FILTER (user_id % 3 = 0) AS host_0, count(DISTINCT user_id) FILTER (user_id % 3 = 1) AS host_1, count(DISTINCT user_id) FILTER (user_id % 3 = 2) AS host_2 FROM events GROUP BY ALL",
    "pareto_front": f"WITH {_FRONT} SELECT * FROM front",
    "supported_frontier": f"""WITH {POINTS_SQL},
b AS (SELECT p.supplier, p.cost, p.loss, max(CASE WHEN o.cost > p.cost THEN -(o.loss - p.loss) / (o.cost - p.cost) END) AS least, min(CASE WHEN o.cost < p.cost THEN -(o.loss - p.loss) / (o.cost - p.cost) END) AS most, coalesce(bool_or(o.cost = p.cost AND o.loss < p.loss), false) AS worse
  FROM points p LEFT JOIN points o ON o.supplier <> p.supplier GROUP BY ALL)
SELECT supplier, cost, loss FROM b WHERE NOT worse AND greatest(coalesce(least, 0), 0) <= coalesce(most, 'inf'::DOUBLE)""",
    "frontier_neighbours": f"""WITH {_FRONT}, n AS (SELECT supplier AS cheap, lead(supplier) OVER o AS dear, round((lead(cost) OVER o - cost) / nullif(loss - lead(loss) OVER o, 0), 6) AS per_unit FROM front WINDOW o AS (ORDER BY cost, supplier))
SELECT * FROM n WHERE dear IS NOT NULL""",
    "confusion_metrics": """WITH c AS (
  SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 600) AS tp, count(*) FILTER (quality = 1 AND n_chars <= 600) AS fn, count(*) FILTER (quality = 0 AND n_chars > 600) AS fp, count(*) FILTER (quality = 0 AND n_chars <= 600) AS tn
  FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall_1, round(tn / nullif(tn + fp, 0), 6) AS recall_0, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""",
    "horizon_metrics": f"WITH {_LAST} SELECT user_id, count(*) FILTER (y <> pred AND seq < 5) AS loss_5, count(*) FILTER (y <> pred AND seq < 20) AS loss_20, count(*) FILTER (y <> pred AND seq < 50) AS loss_50, count(*) AS n FROM scored GROUP BY ALL",
    "segment_metrics": f"""WITH {_LAST}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM scored)
SELECT user_id, (((seq + 1) * 4 - 1) // n)::INTEGER AS segment, count(*) FILTER (y <> pred) AS losses, count(*) AS n FROM k GROUP BY user_id, segment""",
    "preq_last_label": f"WITH {_LAST} SELECT user_id, count(*) FILTER (y <> pred) AS losses, count(*) AS n FROM scored GROUP BY ALL",
    "preq_prefix_majority": f"""WITH {EVENTS_SQL}, p AS (SELECT *, coalesce((2 * sum(y) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > seq)::INTEGER, 0) AS pred FROM events_in_order)
SELECT user_id, count(*) FILTER (y <> pred) AS losses, count(*) AS n FROM p GROUP BY ALL""",
    "preq_recent_window": f"WITH {_LAST} SELECT user_id, event_id, sum((y <> pred)::INTEGER) OVER w::BIGINT AS recent_misses, count(*) OVER w AS recent_rows FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "cum_error_curve": f"WITH {_LAST}, c AS (SELECT user_id, seq::INTEGER AS seq, sum((y <> pred)::INTEGER) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS misses FROM scored) SELECT * FROM c WHERE (seq + 1) % 10 = 0",
    "failure_latch": f"""WITH {EVENTS_SQL}, f AS (SELECT *, max((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY seq) AS failed FROM events_in_order)
SELECT user_id, sum(failed)::BIGINT AS failed_rows, count(*) FILTER (failed = 1 OR y = 0) AS loss FROM f GROUP BY ALL""",
    "chronology_violations": """WITH s AS (SELECT user_id, event_id, ts, lag(ts) OVER w AS before, lag(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, unnest(list_filter([CASE WHEN ts < before THEN 'back' END, CASE WHEN event_id = last THEN 'repeat' END, CASE WHEN ts > before + INTERVAL 24 HOURS THEN 'late' END], lambda x: x IS NOT NULL)) AS rule FROM s""",
    "cart_best_split": f"""WITH {FEATURES_SQL}, v AS (SELECT feature, value, count(*) AS n, sum(y)::BIGINT AS ones FROM long GROUP BY ALL),
s AS (SELECT feature, value, sum(n) OVER o AS nl, sum(ones) OVER o AS ol, sum(n) OVER (PARTITION BY feature) AS nt, sum(ones) OVER (PARTITION BY feature) AS ot, lead(value) OVER (PARTITION BY feature ORDER BY value) AS after FROM v WINDOW o AS (PARTITION BY feature ORDER BY value)),
i AS (SELECT *, round((2 * ol * (nl - ol) / nl + 2 * (ot - ol) * ((nt - nl) - (ot - ol)) / (nt - nl)) / nt, 9) AS impurity FROM s WHERE after IS NOT NULL AND nl >= 5 AND nt - nl >= 5)
SELECT feature::INTEGER AS feature, CASE WHEN value / 2 + after / 2 > value AND value / 2 + after / 2 <= after THEN value / 2 + after / 2 ELSE after END AS threshold, impurity, nl::BIGINT AS left_rows FROM i ORDER BY impurity, feature, value LIMIT 1""",
    "candidate_thresholds": f"""WITH {FEATURES_SQL}, v AS (SELECT feature, list_sort(list(DISTINCT value)) AS vs FROM long GROUP BY feature),
k AS (SELECT feature, vs, len(vs) AS n, least(32, len(vs) - 1) AS slots, unnest(CASE WHEN len(vs) = 1 THEN [0] ELSE range(1, least(32, len(vs) - 1) + 1) END) AS slot FROM v),
m AS (SELECT feature, slot, CASE WHEN n = 1 THEN vs[1] ELSE vs[(slot * (n - 1)) // (slots + 1) + 1] END AS a, CASE WHEN n > 1 THEN vs[(slot * (n - 1)) // (slots + 1) + 2] END AS b FROM k)
SELECT feature::INTEGER AS feature, min(slot)::INTEGER AS slot, CASE WHEN b IS NULL THEN a WHEN a / 2 + b / 2 > a AND a / 2 + b / 2 <= b THEN a / 2 + b / 2 ELSE b END AS cut FROM m GROUP BY feature, cut""",
    "cart_threshold_bins": f"""WITH {FEATURES_SQL}, c AS (SELECT feature::INTEGER AS feature, ((value >= -0.2)::INTEGER + (value >= -0.1)::INTEGER + (value >= 0)::INTEGER + (value >= 0.1)::INTEGER + (value >= 0.2)::INTEGER) AS bin, count(*) AS n, sum(y)::BIGINT AS ones FROM long GROUP BY ALL)
SELECT *, sum(n) OVER o::BIGINT AS n_upto, sum(ones) OVER o::BIGINT AS ones_upto FROM c WINDOW o AS (PARTITION BY feature ORDER BY bin)""",
    "cart_greedy_tree": _greedy_sql(3, 5),
    "mechanism_ols": f"""WITH {PANEL_SQL},
c AS (SELECT scenario, count(*) * covar_pop(quantity, quantity) AS qq, count(*) * covar_pop(tax, tax) AS tt, count(*) * covar_pop(n_rows, n_rows) AS nn, count(*) * covar_pop(quantity, tax) AS qt, count(*) * covar_pop(quantity, n_rows) AS qn,
  count(*) * covar_pop(tax, n_rows) AS tn, count(*) * covar_pop(quantity, discount) AS qy, count(*) * covar_pop(tax, discount) AS ty, count(*) * covar_pop(n_rows, discount) AS ny FROM panel GROUP BY scenario),
m AS (SELECT sum(qq) AS a, sum(qt) AS b, sum(qn) AS c, sum(tt) AS d, sum(tn) AS e, sum(nn) AS f, sum(qy) AS x, sum(ty) AS y, sum(ny) AS z FROM c),
d AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM m)
SELECT 'quantity' AS term, round((x * (d * f - e * e) - b * (y * f - e * z) + c * (y * e - d * z)) / det, 6) AS slope FROM d
UNION ALL SELECT 'tax', round((a * (y * f - e * z) - x * (b * f - e * c) + c * (b * z - y * c)) / det, 6) FROM d
UNION ALL SELECT 'n_rows', round((a * (d * z - y * e) - b * (b * z - y * c) + x * (b * e - d * c)) / det, 6) FROM d""",
    "addr_uniform": f"""SELECT o_orderkey, substr(sha256('["DT-P9-DRAW-v1","0123456789abcdef","FEATURE",' || o_orderkey || ',0]'), 1, 16) AS key, {_bits_sql('FEATURE', 'o_orderkey', 0)}::BIGINT AS bits, round({_u_sql('FEATURE', 'o_orderkey', 0)}, 12) AS u FROM orders""",
    "conf_stream_labels": _stream_sql("'DT-C8E1-F09-v1|CONF|SOURCE|scenario=' || name || '|r=' || lpad((o_orderkey % 320)::VARCHAR, 3, '0')"),  # fixed: the address's form
    "stream_labels": _stream_sql(),
    "bootstrap_t_mean": f"""WITH {_H1}, t AS (SELECT estimate, se_0, CASE WHEN se = 0 THEN 'inf'::DOUBLE ELSE abs(theta - estimate) / se END AS t FROM reps JOIN whole USING (contrast)),
c AS (SELECT estimate, se_0, list_sort(list(t))[{CRITICAL}] AS critical, count(*) FILTER (t >= abs(estimate) / se_0) AS beyond FROM t GROUP BY ALL)
SELECT round(estimate, 6) AS estimate, round(se_0, 6) AS se, round(critical, 6) AS critical, round(estimate - critical * se_0, 6) AS low, round(estimate + critical * se_0, 6) AS high, round((1 + beyond) / {REPLICATES + 1}, 6) AS p FROM c""",
    "bootstrap_percentile_ci": f"WITH {_H1} SELECT {_CI} FROM reps",
    "practical_class": f"WITH {_H1}, c AS (SELECT {_CI} FROM reps) SELECT *, CASE WHEN low > 5 THEN 'BENEFICIAL' WHEN high < -5 THEN 'HARMFUL' WHEN low >= -5 AND high <= 5 THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END AS class FROM c",
    "bootstrap_maxt": "WITH " + _replicates_sql({"discount": "discount", "quantity": "quantity", "tax": "tax"}, PANEL_SQL, "MAXT", """SELECT scenario, realisation, max(discount) FILTER (arm = 0) - max(discount) FILTER (arm = 1) AS discount, max(quantity) FILTER (arm = 0) - max(quantity) FILTER (arm = 1) AS quantity, max(tax) FILTER (arm = 0) - max(tax) FILTER (arm = 1) AS tax FROM panel GROUP BY ALL HAVING count(*) FILTER (arm = 0) > 0 AND count(*) FILTER (arm = 1) > 0""") + """,
t AS (SELECT b, max(CASE WHEN se = 0 THEN 0 ELSE abs(theta - estimate) / se END) AS t FROM reps JOIN whole USING (contrast) GROUP BY b),
c AS (SELECT list_sort(list(t))[9500] AS critical FROM t),
r AS (SELECT contrast, round(estimate, 6) AS estimate, round(critical, 6) AS critical, round(estimate - critical * se_0, 6) AS low, round(estimate + critical * se_0, 6) AS high FROM whole, c)
SELECT *, CASE WHEN high < 0 THEN 'LEFT_LOWER' WHEN low > 0 THEN 'RIGHT_LOWER' ELSE 'UNRESOLVED' END AS direction FROM r""",
    "holm_stepdown": f"""WITH {PAIRED_SQL},
cells AS (SELECT scenario, count(*) AS n, sum(d)::BIGINT AS s, sum(d * d)::BIGINT AS ss FROM paired GROUP BY ALL),
tests AS (SELECT scenario[1] AS family, scenario, round(coalesce(least(1 / nullif((s * s * (n - 1)) / nullif(n * ss - s * s, 0), 0), 1), 1), 9) AS p FROM cells),
steps AS (SELECT *, least((count(*) OVER (PARTITION BY family) - row_number() OVER o + 1) * p, 1) AS step FROM tests WINDOW o AS (PARTITION BY family ORDER BY p, scenario)),
adj AS (SELECT *, max(step) OVER (PARTITION BY family ORDER BY p, scenario ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM steps)
SELECT family, scenario, p, round(a, 6) AS adjusted, a <= 0.05 AS reject FROM adj""",
    "lineage_ancestors": f"WITH RECURSIVE {LINEAGE_SQL}, up(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor) SELECT * FROM up",
    "lineage_depth": f"WITH RECURSIVE {LINEAGE_SQL}, down(node, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey >= 1 AND c_custkey NOT IN (SELECT child FROM edges) UNION SELECT e.child, down.depth + 1 FROM down JOIN edges e ON e.parent = down.node) SELECT node, max(depth) AS depth FROM down GROUP BY node",
    "lineage_rollup": f"""WITH {LINEAGE_SQL}, k AS (SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM edges WHERE child = c_custkey) AS n FROM customer WHERE c_custkey >= 1)
SELECT c_mktsegment, count(*) AS records, count(*) FILTER (n = 1) AS clones, count(*) FILTER (n = 0) AS roots, sum(n)::BIGINT AS parent_links FROM k GROUP BY ALL""",
    "population_diversity": "WITH k AS (SELECT l_suppkey, l_partkey, count(*) AS k FROM lineitem GROUP BY ALL) SELECT l_suppkey, sum(k)::BIGINT AS n, round(1 - sum(k * (k - 1)) / nullif(sum(k) * (sum(k) - 1), 0), 6) AS diversity FROM k GROUP BY ALL",
    "multiset_digest": "WITH k AS (SELECT l_suppkey, l_partkey::VARCHAR AS item, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, sha256(string_agg(item || chr(9) || n, chr(10) ORDER BY item) || chr(10)) AS digest FROM k GROUP BY ALL",
    "order_digest_root": "SELECT o_custkey, sha256(string_agg(o_orderkey || chr(9) || o_orderstatus, chr(10) ORDER BY o_orderkey) || chr(10)) AS digest FROM orders GROUP BY ALL",
    "key_completeness": """WITH e AS (SELECT DISTINCT o_orderkey AS key, o_orderstatus AS status FROM orders), o AS (SELECT DISTINCT l_orderkey AS key, l_linestatus AS status FROM lineitem)
SELECT key, status, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT key, status, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""",
    "duplicate_keys": "SELECT l_orderkey, l_partkey, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "one_hot": """SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(o_orderstatus = 'F', false)::INTEGER AS o_orderstatus_0, coalesce(o_orderstatus = 'O', false)::INTEGER AS o_orderstatus_1, coalesce(o_orderstatus NOT IN ('F', 'O'), false)::INTEGER AS o_orderstatus_unknown, (o_orderstatus IS NULL)::INTEGER AS o_orderstatus_missing,
  coalesce(o_orderpriority = '1-URGENT', false)::INTEGER AS o_orderpriority_0, coalesce(o_orderpriority = '2-HIGH', false)::INTEGER AS o_orderpriority_1, coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), false)::INTEGER AS o_orderpriority_unknown, (o_orderpriority IS NULL)::INTEGER AS o_orderpriority_missing FROM orders""",
}


def _join_studies() -> None:
    """The studies use this module's tables, so they come last."""
    from tidemark.plans import chances, learning, studies, trails

    for plans in (studies, learning, trails, chances):
        QUERIES.update(plans.QUERIES)
        ORACLE_SQL.update(plans.ORACLE_SQL)


_join_studies()
