"""Registered queries of whole studies: inference, decisions, records, key sets, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import addressing, classify
from tidemark.functions import scenarios as sc
from tidemark.operators import checks, frontier, ordered, panel, resample, selection, trees
from tidemark.plans import registry as r
from tidemark.sources import records

METRICS = ("discount", "quantity", "tax")
PAIRS = ((0, 1), (0, 2), (1, 2))
KEY = "0123456789abcdef"

#: Kinds of events that each customer should have.
KNOWN_TYPES = ("click", "purchase", "signup", "view")


# ---- inference and decisions ----


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return r._panel(spark, d).withColumn("arm", F.col("arm").cast("long"))


def _arm_draws() -> Column:
    """Each arm has draws of its own."""
    return F.concat(F.lit("RATIO"), F.col("arm").cast("string"))


def _welch(spark: SparkSession, d: str) -> DataFrame:
    found = panel.effective_freedom(r._contrasts(spark, d), *METRICS)
    return found.withColumn("hoeffding", F.round(classify.hoeffding_radius(F.lit(1), F.col("n"), 0.05, 3), 9))


def _all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A column for each pair of arms and metric: the left arm's value less the right one's, of cells that have all arms."""
    cells = r._panel(spark, d).groupBy("scenario", "realisation").agg(*(F.max(F.when(F.col("arm") == a, F.col(m))).alias(f"{m}_{a}") for a in (0, 1, 2) for m in METRICS), F.count("*").alias("arms"))
    return cells.where("arms = 3").select("scenario", "realisation", *((F.col(f"{m}_{a}") - F.col(f"{m}_{b}")).alias(f"{a}{b}_{m}") for a, b in PAIRS for m in METRICS))


def _dominance(spark: SparkSession, d: str) -> DataFrame:
    found = resample.max_t(_all_pairs(spark, d), [f"{a}{b}_{m}" for a, b in PAIRS for m in METRICS], r.REPLICATES, "PAIRS")
    found = found.select(F.split("contrast", "_")[0].alias("pair"), F.split("contrast", "_")[1].alias("metric"), classify.direction(F.col("low"), F.col("high")).alias("side"))
    wide = found.groupBy("pair").pivot("metric", list(METRICS)).agg(F.first("side"))
    whole = lambda *metrics: classify.dominance([F.col(m) for m in metrics], F.substring("pair", 1, 1), F.substring("pair", 2, 1))
    return wide.select("pair", *METRICS, whole(*METRICS).alias("on_all"), whole("quantity", "tax").alias("on_resources"))


def _break_even(spark: SparkSession, d: str) -> DataFrame:
    """Arm 1 as the better and dearer method: what it saves in discount, and what it costs more in quantity."""
    cells = r._contrasts(spark, d).select("scenario", "realisation", F.col("discount").alias("saved"), (-F.col("quantity")).alias("premium"))
    at = resample.placed(cells)
    reps = resample.replicate_moments(at, ["saved", "premium"], r.REPLICATES, "EVEN").withColumnRenamed("contrast", "what")
    low = reps.groupBy("what").agg(F.element_at(F.array_sort(F.collect_list("theta")), r.LOW).alias("low"))
    both = resample.whole_moments(at, ["saved", "premium"]).withColumnRenamed("contrast", "what").join(low, "what")
    row = both.agg(*(F.max(F.when(F.col("what") == w, F.col(c))).alias(f"{w}_{c}") for w in ("saved", "premium") for c in ("theta", "low")))
    side = lambda w: {"estimate": F.col(f"{w}_theta"), "low": F.col(f"{w}_low")}
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns), *frontier.break_even(side("saved"), side("premium"), 24_000))


_RATIO_SQL = f"""{r.PANEL_SQL},
base AS (SELECT arm::BIGINT AS arm, scenario, realisation, discount AS a, n_rows AS q FROM panel),
placed AS (SELECT *, row_number() OVER (PARTITION BY arm, scenario ORDER BY realisation) - 1 AS place FROM base),
sizes AS (SELECT arm, scenario, count(*) AS n FROM placed GROUP BY ALL),
tape AS (
  SELECT arm, b, scenario, (('0x' || substr(sha256('RATIO' || arm || '|' || b || '|' || scenario || '|' || i), 1, 16))::UBIGINT >> 11)::BIGINT % n AS place
  FROM (SELECT arm, scenario, n, b, unnest(range(n)) AS i FROM sizes, range({r.REPLICATES}) r(b))),
every AS (SELECT arm, b, scenario, a, q FROM tape JOIN placed USING (arm, scenario, place) UNION ALL SELECT arm, -1, scenario, a, q FROM base),
cells AS (SELECT arm, b, scenario, count(*) AS n, sum(a)::BIGINT AS a, sum(q)::BIGINT AS q, sum(a * a)::BIGINT AS aa, sum(q * q)::BIGINT AS qq, sum(a * q)::BIGINT AS aq FROM every GROUP BY ALL),
w AS (SELECT arm, b, avg(a / n) AS ma, avg(q / n) AS mq, sum((n * aa - a * a) / (n * (n - 1)) / n) AS va, sum((n * qq - q * q) / (n * (n - 1)) / n) AS vq, sum((n * aq - a * q) / (n * (n - 1)) / n) AS c, count(*) AS g FROM cells GROUP BY arm, b),
t AS (SELECT arm, b, mq, g, va, vq, c, CASE WHEN mq > 0 THEN ma / mq END AS theta FROM w),
reps AS (SELECT arm, b, mq, theta, sqrt(greatest(va - 2 * theta * c + theta * theta * vq, 0)) / (g * mq) AS se FROM t)"""

_PAIRS_SQL = f"""{r.PANEL_SQL},
wide AS (SELECT scenario, realisation, {', '.join(f'max({m}) FILTER (arm = {a}) AS {m}_{a}' for a in (0, 1, 2) for m in METRICS)} FROM panel GROUP BY ALL HAVING count(*) = 3)"""
_PAIR_COLUMNS = {f"{a}{b}_{m}": f'"{a}{b}_{m}"' for a, b in PAIRS for m in METRICS}
_PAIR_ROWS = f"""SELECT scenario, realisation, {', '.join(f'{m}_{a} - {m}_{b} AS "{a}{b}_{m}"' for a, b in PAIRS for m in METRICS)} FROM wide"""
_CONTRASTS_SQL = "SELECT scenario, realisation, " + ", ".join(f"max({m}) FILTER (arm = 0) - max({m}) FILTER (arm = 1) AS {m}" for m in METRICS) + " FROM panel GROUP BY ALL HAVING count(*) FILTER (arm = 0) > 0 AND count(*) FILTER (arm = 1) > 0"
_SIDE = "CASE WHEN {c} < 0 THEN 'LEFT_LOWER' WHEN {d} > 0 THEN 'RIGHT_LOWER' ELSE 'UNRESOLVED' END"


# ---- records ----

ARMS = "struct<l_orderkey: bigint, arms: map<string, struct<price: double, use: struct<quantity: bigint>>>>"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON records with a map of their line numbers, as text, read back strictly."""
    lines = r._t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    entry = F.struct(F.col("l_linenumber").cast("string").alias("key"), F.struct("price", F.struct("quantity").alias("use")).alias("value"))
    orders = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(entry)).alias("arms"))
    return orders.select(F.to_json(F.struct("l_orderkey", "arms")).alias("text")).select(F.from_json("text", ARMS, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    names = ["n_regionkey", "n_nationkey", "n_name"]
    text = records.canonical_json(*names, names=names)
    return r._t(spark, d, "nation").select("n_nationkey", text.alias("json"), records.record_digest(text).alias("digest"))


def _early(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the orders of the first fifth of the time that all orders cover."""
    dates = r._t(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    bounds = dates.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    return dates.join(F.broadcast(bounds), F.col("day") <= F.col("first") + F.floor((F.col("last") - F.col("first")) / 5)).select("o_orderkey")


def _encoder(spark: SparkSession, d: str) -> DataFrame:
    """Prices without those of urgent orders and priorities of orders, fitted on the orders of the first fifth of the time covered."""
    rows = r._t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_orderpriority")
    fitted = checks.fit_encoder(rows.join(_early(spark, d), "o_orderkey", "left_semi"), ["price"], ["status", "o_orderpriority"])
    return checks.encode_with(rows, fitted, ["price"], ["status", "o_orderpriority"]).withColumn("price", F.round("price", 6))


# ---- selections ----


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return r._t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.bin(F.col("c_custkey") % 1024).alias("path")).distinct()


def _champions(spark: SparkSession, d: str) -> DataFrame:
    customers = r._t(spark, d, "customer").select("c_custkey", "c_nationkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("digest"))
    return selection.canonical(customers, "c_nationkey", F.col("c_custkey") % 100 == 7, F.col("digest")).drop("digest")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return r._t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")


QUERIES: dict[str, r.Query] = {
    "bootstrap_t_ratio": lambda s, d: resample.bootstrap_t_ratio(_arms(s, d), "discount", "n_rows", r.REPLICATES, _arm_draws(), r.FAMILY_LEVEL, by="arm"),
    "bootstrap_percentile_ratio": lambda s, d: resample.percentile_ratio(_arms(s, d), "discount", "n_rows", r.REPLICATES, _arm_draws(), by="arm"),
    "cluster_bootstrap_interval": lambda s, d: resample.cluster_interval(r._contrasts(s, d), list(METRICS), r.REPLICATES, "CLUSTER", 0.05 / 6),
    "slope_bootstrap": lambda s, d: resample.slope_interval(r._panel(s, d), "discount", ["quantity", "n_rows"], r.REPLICATES, "SLOPES"),
    "welch_freedom": _welch,
    "uncertainty_dominance": _dominance,
    "break_even_record": _break_even,
    "resource_increments": lambda s, d: panel.increments(r._panel(s, d), 0, 1, *METRICS),
    "closure_check": lambda s, d: panel.closure(r._panel(s, d), "discount", 0, 1, 2),
    "eligibility_rate": lambda s, d: panel.eligibility(r._panel(s, d), F.col("discount") > 20, "scenario"),
    "nested_mean": lambda s, d: panel.nested_mean(_lines(s, d).withColumn("quantity", F.col("l_quantity").cast("long")), "quantity", ("l_suppkey", "l_returnflag", "l_orderkey"), ("l_suppkey", "l_returnflag"), ("l_suppkey",)),
    "material_components": lambda s, d: panel.components(r._panel(s, d).withColumn("eligible", F.col("n_rows") > 2), "discount", "eligible", "scenario", "arm"),
    "calibration_ceiling": lambda s, d: panel.ceiling(r._panel(s, d), "quantity", "scenario"),
    "record_flatten": lambda s, d: records.flattened(_records(s, d), ["l_orderkey"], "arms", {"quantity": ("use.quantity", 1), "hundreds": ("price", 100.0)}).withColumn("hundreds", F.round("hundreds", 6)),
    "record_optional_path": lambda s, d: _records(s, d).select("l_orderkey", records.measured("arms.5.use.quantity").alias("quantity")),
    "canonical_records": _canonical,
    "seed_schedule": lambda s, d: records.seed_schedule(sc.scenarios(), 80, ["HAT", "ARF", "EFDT"], s),
    "id_prefix_parse": lambda s, d: r._t(s, d, "customer").select("c_custkey", F.regexp_extract("c_name", r"^([A-Za-z]+)#0*(\d+)$", 1).alias("family"), F.regexp_extract("c_name", r"^([A-Za-z]+)#0*(\d+)$", 2).cast("long").alias("number")),
    "host_segment": lambda s, d: r._t(s, d, "supplier").select("s_suppkey", reduce(lambda a, b: a + b, ((F.col("s_suppkey") > c).cast("int") for c in (3, 30, 60))).alias("segment")),
    "expected_cells": lambda s, d: checks.key_differences(checks.expected_keys(r._t(s, d, "customer").select(F.col("c_custkey").alias("user")), list(KNOWN_TYPES), "kind"), r._t(s, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("kind")), ["user", "kind"]),
    "complete_groups": lambda s, d: checks.incomplete_groups(_lines(s, d), ["l_orderkey"], "l_linenumber", [1, 2, 3, 4]),
    "common_ids": lambda s, d: r._t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id")).intersect(_lines(s, d).select(F.col("l_partkey").cast("long").alias("id"))),
    "all_ids": lambda s, d: r._t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit("customer").alias("of")).union(r._t(s, d, "supplier").select(F.col("s_suppkey").cast("long"), F.lit("supplier"))).groupBy("id").agg(F.count("*").alias("times"), F.min("of").alias("first_of")),
    "set_retention": lambda s, d: checks.retention(_lines(s, d).where("l_returnflag = 'R'"), _lines(s, d).where("l_returnflag = 'N'"), ["l_suppkey"], "l_partkey"),
    "segment_ends": lambda s, d: ordered.ends(r._events(s, d), "user_id", "seq", "event_type", "event_id"),
    "contiguity_gaps": lambda s, d: ordered.gaps(_lines(s, d), "l_orderkey", "l_linenumber"),
    "hash_chain": lambda s, d: ordered.hash_chain(r._t(s, d, "orders"), "o_custkey", "o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus")),
    "duplicate_rank": lambda s, d: ordered.duplicate_rank(_lines(s, d).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_partkey"], "l_orderkey", "l_linenumber"),
    "class_horizon_metrics": lambda s, d: ordered.class_losses(ordered.last_label(r._events(s, d), "user_id"), "user_id", [20, 50], "y", "pred"),
    "prefix_encoder": _encoder,
    "tree_summary": lambda s, d: trees.summary(r.QUERIES["cart_greedy_tree"](s, d)),
    "survivors": lambda s, d: selection.survivors(r._t(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 5),
    "tournament": lambda s, d: selection.tournament(r._t(s, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 20, 7, KEY, "tournament"),
    "canonical_order": _champions,
    "maximal_sites": lambda s, d: selection.maximal_sites(_sites(s, d), "nation", "path"),
    "random_choice": lambda s, d: r._t(s, d, "customer").select("c_custkey", addressing.chosen(F.array(*map(F.lit, sc.FAMILIES + sc.DRIFTS)), addressing.uniform_at(F.lit(KEY), F.lit("choice"), F.col("c_custkey"), F.lit(0))).alias("chosen"), addressing.seed_32(F.concat(F.lit("seed|"), F.col("c_custkey").cast("string"))).alias("seed")),
    "contract_violations": lambda s, d: checks.violations(_lines(s, d), ["l_orderkey", "l_linenumber"], {"line": F.col("l_linenumber").between(1, 6), "discount": (F.col("l_discount") >= 0) & (F.col("l_discount") <= 0.09), "flag": F.col("l_returnflag").isin("A", "N"), "supplier": F.col("l_suppkey").isNotNull()}),
    "range_digest_root": lambda s, d: checks.range_digest(r._t(s, d, "orders"), "o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus")),
}

_U = f"least(((('0x' || substr(sha256('[\"DT-P9-DRAW-v1\",\"{KEY}\",\"' || {{role}} || '\",' || {{index}} || ',' || {{draw}} || ']'), 1, 16))::UBIGINT >> 11)::DOUBLE + 0.5) / 9007199254740992.0, 1 - 1.1102230246251565e-16)"

ORACLE_SQL: dict[str, str] = {
    "bootstrap_t_ratio": f"""WITH {_RATIO_SQL},
o AS (SELECT arm, theta AS estimate, se AS se_0, mq AS denominator FROM reps WHERE b = -1),
p AS (SELECT arm, estimate, se_0, denominator, CASE WHEN theta IS NULL OR se = 0 OR se IS NULL THEN 'inf'::DOUBLE ELSE abs(theta - estimate) / se END AS t FROM reps JOIN o USING (arm) WHERE b >= 0),
c AS (SELECT arm, estimate, se_0, denominator, list_sort(list(t))[{r.CRITICAL}] AS critical, count(*) FILTER (t >= abs(estimate) / se_0) AS beyond FROM p GROUP BY ALL)
SELECT arm, round(estimate, 6) AS estimate, round(denominator, 6) AS denominator, round(se_0, 6) AS se, round(critical, 6) AS critical, round(estimate - critical * se_0, 6) AS low, round(estimate + critical * se_0, 6) AS high, round((1 + beyond) / {r.REPLICATES + 1}, 6) AS p FROM c""",
    "bootstrap_percentile_ratio": f"WITH {_RATIO_SQL} SELECT arm, round(list_sort(list(theta))[{r.LOW}], 6) AS low, round(list_sort(list(theta))[{r.HIGH}], 6) AS high, count(theta) AS finite FROM reps WHERE b >= 0 AND theta IS NOT NULL GROUP BY arm",
    "cluster_bootstrap_interval": "WITH " + r._replicates_sql({m: m for m in METRICS}, r.PANEL_SQL, "CLUSTER", _CONTRASTS_SQL) + " SELECT contrast, round(quantile_cont(theta, 0.05 / 6), 6) AS low, round(quantile_cont(theta, 1 - 0.05 / 6), 6) AS high FROM reps GROUP BY contrast",
    "slope_bootstrap": f"""WITH {r.PANEL_SQL},
parts AS (SELECT scenario, realisation, count(*) AS n, sum(quantity)::DOUBLE AS q, sum(n_rows)::DOUBLE AS m, sum(discount)::DOUBLE AS y, sum(quantity * quantity)::DOUBLE AS qq, sum(n_rows * n_rows)::DOUBLE AS mm, sum(quantity * n_rows)::DOUBLE AS qm, sum(quantity * discount)::DOUBLE AS qy, sum(n_rows * discount)::DOUBLE AS my FROM panel GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY realisation) - 1 AS place FROM parts),
sizes AS (SELECT scenario, count(*) AS k FROM placed GROUP BY ALL),
tape AS (
  SELECT b, scenario, (('0x' || substr(sha256('SLOPES|' || b || '|' || scenario || '|' || i), 1, 16))::UBIGINT >> 11)::BIGINT % k AS place
  FROM (SELECT scenario, k, b, unnest(range(k)) AS i FROM sizes, range({r.REPLICATES}) r(b))),
cells AS (SELECT b, scenario, sum(n) AS n, sum(q) AS q, sum(m) AS m, sum(y) AS y, sum(qq) AS qq, sum(mm) AS mm, sum(qm) AS qm, sum(qy) AS qy, sum(my) AS my FROM tape JOIN placed USING (scenario, place) GROUP BY ALL),
c AS (SELECT b, sum(qq - q * q / n) AS qq, sum(mm - m * m / n) AS mm, sum(qm - q * m / n) AS qm, sum(qy - q * y / n) AS qy, sum(my - m * y / n) AS my FROM cells GROUP BY b),
s AS (SELECT 'quantity' AS term, (qy * mm - my * qm) / (qq * mm - qm * qm) AS slope FROM c UNION ALL SELECT 'n_rows', (my * qq - qy * qm) / (qq * mm - qm * qm) FROM c)
SELECT term, round(list_sort(list(slope))[{r.LOW}], 6) AS low, round(list_sort(list(slope))[{r.HIGH}], 6) AS high, count(*) AS finite FROM s GROUP BY term""",
    "welch_freedom": f"""WITH {r.PANEL_SQL}, base AS ({_CONTRASTS_SQL}), long AS (UNPIVOT base ON {', '.join(METRICS)} INTO NAME contrast VALUE x),
cells AS (SELECT contrast, scenario, avg(x) AS m, CASE WHEN min(x) = max(x) THEN 0 ELSE var_samp(x) END / count(x) AS v, count(x) AS n FROM long GROUP BY ALL),
w AS (SELECT contrast, avg(m) AS estimate, sum(v) AS s, sum(v * v / (n - 1)) AS d, count(*) AS g, sum(n)::BIGINT AS n FROM cells GROUP BY contrast)
SELECT contrast, round(estimate, 6) AS estimate, round(s / (g * g), 10) AS variance, round(s * s / nullif(d, 0), 6) AS freedom, g AS groups, n, round(sqrt(2 * ln(6 / 0.05::DOUBLE) / n), 9) AS hoeffding FROM w""",
    "uncertainty_dominance": "WITH " + r._replicates_sql(_PAIR_COLUMNS, _PAIRS_SQL, "PAIRS", _PAIR_ROWS) + f""",
t AS (SELECT b, max(CASE WHEN se = 0 THEN 0 ELSE abs(theta - estimate) / se END) AS t FROM reps JOIN whole USING (contrast) GROUP BY b),
c AS (SELECT list_sort(list(t))[{r.HIGHER}] AS critical FROM t),
s AS (SELECT split_part(contrast, '_', 1) AS pair, split_part(contrast, '_', 2) AS metric, {_SIDE.format(c='round(estimate + critical * se_0, 6)', d='round(estimate - critical * se_0, 6)')} AS side FROM whole, c),
p AS (SELECT pair, {', '.join(f"max(side) FILTER (metric = '{m}') AS {m}" for m in METRICS)}, min(side) AS lo, max(side) AS hi, min(side) FILTER (metric <> 'discount') AS rlo, max(side) FILTER (metric <> 'discount') AS rhi FROM s GROUP BY pair)
SELECT pair, {', '.join(METRICS)}, CASE WHEN lo = hi AND lo = 'RIGHT_LOWER' THEN pair[2] WHEN lo = hi AND lo = 'LEFT_LOWER' THEN pair[1] END AS on_all,
  CASE WHEN rlo = rhi AND rlo = 'RIGHT_LOWER' THEN pair[2] WHEN rlo = rhi AND rlo = 'LEFT_LOWER' THEN pair[1] END AS on_resources FROM p""",
    "break_even_record": "WITH " + r._replicates_sql({"saved": "saved", "premium": "premium"}, f"{r.PANEL_SQL}, d AS ({_CONTRASTS_SQL})", "EVEN", "SELECT scenario, realisation, discount AS saved, -quantity AS premium FROM d") + f""",
low AS (SELECT contrast, list_sort(list(theta))[{r.LOW}] AS low FROM reps GROUP BY contrast),
v AS (SELECT max(estimate) FILTER (contrast = 'saved') AS st, max(low) FILTER (contrast = 'saved') AS sl, max(estimate) FILTER (contrast = 'premium') AS pt, max(low) FILTER (contrast = 'premium') AS pl FROM whole JOIN low USING (contrast))
SELECT round(st, 6) AS saved_theta, round(sl, 6) AS saved_low, round(pt, 6) AS premium_theta, round(pl, 6) AS premium_low, CASE WHEN sl > 0 AND pl > 0 THEN 'STABLE' ELSE 'UNSTABLE_ACCURACY_INCREMENT' END AS status,
  CASE WHEN sl > 0 AND pl > 0 THEN round(pt / (100 * st), 6) END AS per_point, CASE WHEN sl > 0 AND pl > 0 THEN round(pt / (24000 * st), 6) END AS per_error, CASE WHEN sl > 0 AND pl > 0 THEN round(st / pt, 6) END AS rate FROM v""",
    "resource_increments": f"WITH {r.PANEL_SQL} SELECT scenario, realisation, " + ", ".join(f"max({m}) FILTER (arm = 1) - max({m}) FILTER (arm = 0) AS {m}" for m in METRICS) + " FROM panel WHERE arm < 2 GROUP BY ALL",
    "closure_check": f"""WITH {r.PANEL_SQL}, w AS (SELECT scenario, realisation, max(discount) FILTER (arm = 0) AS a, max(discount) FILTER (arm = 1) AS b, max(discount) FILTER (arm = 2) AS c FROM panel GROUP BY ALL)
SELECT sum(a - b)::BIGINT AS j1, sum(b - c)::BIGINT AS j2, sum(a - c)::BIGINT AS j_sum, count(*) AS cells, sum(a - b) + sum(b - c) = sum(a - c) AS closed FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""",
    "eligibility_rate": f"WITH {r.PANEL_SQL} SELECT scenario, grouping(scenario) = 1 AS overall, count(*) AS n, sum((discount > 20)::INTEGER)::BIGINT AS eligible, round(avg((discount > 20)::INTEGER), 6) AS rate FROM panel GROUP BY GROUPING SETS ((scenario), ())",
    "nested_mean": "SELECT l_suppkey, round(avg(m), 6) AS quantity FROM (SELECT l_suppkey, l_returnflag, avg(m) AS m FROM (SELECT l_suppkey, l_returnflag, l_orderkey, avg(l_quantity::BIGINT) AS m FROM lineitem GROUP BY ALL) GROUP BY ALL) GROUP BY l_suppkey",
    "material_components": f"WITH {r.PANEL_SQL} SELECT scenario, arm, round(avg(CASE WHEN n_rows > 2 THEN discount ELSE 0 END), 6) AS a, round(avg((n_rows > 2)::INTEGER), 6) AS q, round(avg(discount) FILTER (n_rows > 2), 6) AS conditional FROM panel GROUP BY ALL",
    "calibration_ceiling": f"WITH {r.PANEL_SQL} SELECT scenario, max(quantity) AS largest, sum(quantity)::BIGINT AS total, 2 * max(quantity) AS bound FROM panel GROUP BY ALL",
    "record_flatten": "SELECT l_orderkey, l_linenumber::VARCHAR AS arm, sum(l_quantity::BIGINT)::DOUBLE AS quantity, round(max(l_extendedprice) / 100, 6) AS hundreds FROM lineitem GROUP BY ALL",
    "record_optional_path": "SELECT l_orderkey, sum(l_quantity::BIGINT) FILTER (l_linenumber = 5)::DOUBLE AS quantity FROM lineitem GROUP BY ALL",
    "canonical_records": """WITH j AS (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation) SELECT *, sha256(json) AS digest FROM j""",
    "seed_schedule": f"SELECT scenario, realisation, method, substr(sha256(scenario || '|r=' || lpad(realisation::VARCHAR, 3, '0') || '|' || method), 1, 16) AS key FROM unnest([{', '.join(repr(x) for x in sc.scenarios())}]) s(scenario), range(80) n(realisation), unnest(['HAT', 'ARF', 'EFDT']) m(method)",
    "id_prefix_parse": r"SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*(\d+)$', 1) AS family, regexp_extract(c_name, '^([A-Za-z]+)#0*(\d+)$', 2)::BIGINT AS number FROM customer",
    "host_segment": "SELECT s_suppkey, CASE WHEN s_suppkey <= 3 THEN 0 WHEN s_suppkey <= 30 THEN 1 WHEN s_suppkey <= 60 THEN 2 ELSE 3 END AS segment FROM supplier",
    "expected_cells": f"""WITH e AS (SELECT c_custkey AS "user", kind FROM customer, unnest({list(KNOWN_TYPES)}) k(kind)), o AS (SELECT DISTINCT user_id AS "user", event_type AS kind FROM events)
SELECT "user", kind, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT "user", kind, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""",
    "complete_groups": """WITH g AS (SELECT l_orderkey, (4 - count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4))::INTEGER AS missing, (count(*) - count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4))::INTEGER AS extra FROM lineitem GROUP BY ALL)
SELECT * FROM g WHERE missing > 0 OR extra > 0""",
    "common_ids": "SELECT c_custkey::BIGINT AS id FROM customer INTERSECT SELECT l_partkey::BIGINT FROM lineitem",
    "all_ids": "SELECT id, count(*) AS times, min(of) AS first_of FROM (SELECT c_custkey::BIGINT AS id, 'customer' AS of FROM customer UNION ALL SELECT s_suppkey::BIGINT, 'supplier' FROM supplier) GROUP BY id",
    "set_retention": """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')
SELECT b.l_suppkey, count(a.l_partkey) AS kept, count(*) AS of, round(count(a.l_partkey) / count(*), 6) AS retained FROM b LEFT JOIN a USING (l_suppkey, l_partkey) GROUP BY ALL""",
    "segment_ends": f"WITH {r.EVENTS_SQL} SELECT user_id, arg_min(event_type, seq) AS first_event_type, arg_max(event_type, seq) AS last_event_type, arg_min(event_id, seq) AS first_event_id, arg_max(event_id, seq) AS last_event_id FROM events_in_order GROUP BY user_id",
    "contiguity_gaps": "WITH g AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1)::BIGINT AS expected FROM lineitem) SELECT * FROM g WHERE l_linenumber <> expected",
    "hash_chain": """WITH RECURSIVE e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey || chr(9) || o_orderstatus AS event FROM orders),
c(o_custkey, i, chain) AS (SELECT o_custkey, i, sha256(event) FROM e WHERE i = 1 UNION ALL SELECT c.o_custkey, e.i, sha256(c.chain || e.event) FROM c JOIN e ON e.o_custkey = c.o_custkey AND e.i = c.i + 1)
SELECT o_custkey, max(i) AS events, arg_max(chain, i) AS chain FROM c GROUP BY o_custkey""",
    "duplicate_rank": "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber)::INTEGER AS nth FROM lineitem",
    "class_horizon_metrics": f"WITH {r._LAST} SELECT user_id, "
    + ", ".join(
        f"count(*) FILTER (seq < {h} AND y <> pred AND y = 0) AS errors_0_{h}, count(*) FILTER (seq < {h} AND y <> pred AND y = 1) AS errors_1_{h}, count(*) FILTER (seq < {h} AND y = 0) AS n_0_{h}, count(*) FILTER (seq < {h} AND y = 1) AS n_1_{h}, "
        f"round((count(*) FILTER (seq < {h} AND y <> pred AND y = 0) / nullif(count(*) FILTER (seq < {h} AND y = 0), 0) + count(*) FILTER (seq < {h} AND y <> pred AND y = 1) / nullif(count(*) FILTER (seq < {h} AND y = 1), 0)) / 2, 6) AS balanced_error_{h}"
        for h in (20, 50)
    )
    + " FROM scored GROUP BY user_id",
    "prefix_encoder": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority FROM orders),
f AS (SELECT quantile_cont(price, 0.5) AS median, list_sort(list(DISTINCT status) FILTER (status IS NOT NULL)) AS statuses, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM o WHERE o_orderkey IN (SELECT o_orderkey FROM orders, (SELECT min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last FROM orders) WHERE o_orderdate::DATE <= first + ((last - first) // 5)::INTEGER))
SELECT o_orderkey, round(coalesce(price, median), 6) AS price, (price IS NULL)::INTEGER AS price_missing, CASE WHEN status IS NULL THEN -2 ELSE coalesce(list_position(statuses, status), 0) - 1 END::INTEGER AS status,
  CASE WHEN o_orderpriority IS NULL THEN -2 ELSE coalesce(list_position(priorities, o_orderpriority), 0) - 1 END::INTEGER AS o_orderpriority FROM o, f""",
    "tree_summary": f"WITH s AS ({r._greedy_sql(3, 5)}) SELECT count(*) AS splits, 2 * count(*) + 1 AS nodes, (floor(log2(max(node))) + 1)::INTEGER AS depth, sha256(string_agg(node || '|' || feature || '|' || round(threshold * 1e9)::BIGINT, chr(10) ORDER BY node)) AS fingerprint FROM s",
    "survivors": "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 5",
    "tournament": f"""WITH n AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
d AS (SELECT c_nationkey, round, draw, floor({_U.format(role="'tournament:' || c_nationkey", index='round', draw='draw')} * n)::BIGINT AS place FROM (SELECT DISTINCT c_nationkey, n FROM n), range(20) a(round), range(7) b(draw)),
m AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, round ORDER BY c_acctbal DESC, draw) AS best FROM d JOIN n USING (c_nationkey, place))
SELECT c_nationkey, round::INTEGER AS round, c_custkey AS winner FROM m WHERE best = 1""",
    "canonical_order": "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 100 = 7) DESC, sha256(c_name))::INTEGER AS place FROM customer",
    "maximal_sites": "WITH s AS (SELECT DISTINCT c_nationkey AS nation, bin(c_custkey % 1024) AS path FROM customer) SELECT nation, path FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.nation = s.nation AND len(o.path) < len(s.path) AND starts_with(s.path, o.path))",
    "random_choice": f"SELECT c_custkey, (['LOCAL_TREE', 'OBLIQUE', 'ABRUPT', 'GRADUAL', 'RECURRENT'])[floor({_U.format(role=repr('choice'), index='c_custkey', draw='0')} * 5)::INTEGER + 1] AS chosen, ('0x' || substr(sha256('seed|' || c_custkey), 1, 8))::BIGINT AS seed FROM customer",
    "contract_violations": """SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT l_linenumber BETWEEN 1 AND 6 THEN 'line' END, CASE WHEN NOT (l_discount >= 0 AND l_discount <= 0.09::DOUBLE) THEN 'discount' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END, CASE WHEN l_suppkey IS NULL THEN 'supplier' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""",
    "range_digest_root": """WITH l AS (SELECT o_orderkey // 4096 AS range, sha256(string_agg(o_orderkey || chr(9) || o_orderstatus, chr(10) ORDER BY o_orderkey) || chr(10)) AS digest FROM orders GROUP BY 1),
b AS (SELECT range // 4096 AS block, sha256(string_agg(digest, chr(10) ORDER BY range) || chr(10)) AS d, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY block) || chr(10)) AS digest, sum(n)::BIGINT AS ranges FROM b""",
}
