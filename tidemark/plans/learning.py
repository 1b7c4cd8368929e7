"""Registered queries of trees: refits along a stream, populations scored over rows, sites and the rows that reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import forests, rolling, trees
from tidemark.plans import registry as r

#: Rows of a user before the first prediction, rows that a refit learns from, and rows between refits.
WARMUP, WINDOW, EVERY = 20, 30, 6
DEPTH, MIN_LEAF = 2, 2

#: Trees of the registered population, their depth, and rows that a leaf has at least.
TREES, TREE_DEPTH, TREE_LEAF = 8, 3, 5

#: Cuts of each feature that a refitted template may take.
SLOTS = 8

#: The path whose rows are asked for: left, then right.
PATH = [0, 1]


# ---- refits along a stream ----


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Users' events in order, with features known before the label: value, hour, and what came before."""
    before = Window.partitionBy("user_id").orderBy("seq")
    past = lambda c: F.coalesce(F.lag(c).over(before).cast("double"), F.lit(0.0))
    x = F.array(F.col("value").cast("double"), F.hour("ts").cast("double"), past("y"), past("value"))
    return r._events(spark, d).select("user_id", "event_id", "seq", "y", x.alias("x"))


def _scored(spark: SparkSession, d: str, **cadence: int) -> DataFrame:
    return rolling.prequential(_stream(spark, d), "user_id", "seq", "x", "y", WARMUP, **cadence, depth=DEPTH, min_leaf=MIN_LEAF)


def rolling_cart(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, window=WINDOW, every=EVERY).select("user_id", "event_id", "refit", "fitted_at", "pred", "y")


def frozen_cart(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("user_id", "event_id", "pred", "y")


def cart_control_losses(spark: SparkSession, d: str) -> DataFrame:
    both = {"FROZEN_CART": _scored(spark, d), "ROLLING_CART": _scored(spark, d, window=WINDOW, every=EVERY)}
    found = [rolling.loss_summary(s, "user_id", "y").withColumn("method", F.lit(m)) for m, s in both.items()]
    return found[0].unionByName(found[1])


def _forest_sql(base: str, by: str, depth: int, min_leaf: int) -> str:
    """CTEs up to `nodes` of the trees that grow from the rows of `base` (by, v, y), level by level."""
    sql, rows = [], f"SELECT *, 1::BIGINT AS node FROM ({base})"
    for k in range(depth):
        sql.append(f"""r{k} AS ({rows}),
c{k} AS (SELECT {by}, node, count(*) AS n, sum(y)::BIGINT AS ones FROM r{k} GROUP BY ALL),
l{k} AS (SELECT {by}, node, y, generate_subscripts(v, 1) - 1 AS feature, unnest(v) AS value FROM r{k} JOIN c{k} USING ({by}, node) WHERE ones > 0 AND ones < n),
v{k} AS (SELECT {by}, node, feature, value, count(*) AS m, sum(y)::BIGINT AS o FROM l{k} GROUP BY ALL),
w{k} AS (SELECT {by}, node, feature, value, sum(m) OVER a AS nl, sum(o) OVER a AS ol, sum(m) OVER b AS nt, sum(o) OVER b AS ot, lead(value) OVER a AS after FROM v{k}
  WINDOW a AS (PARTITION BY {by}, node, feature ORDER BY value), b AS (PARTITION BY {by}, node, feature)),
i{k} AS (SELECT *, round((2 * ol * (nl - ol) / nl + 2 * (ot - ol) * ((nt - nl) - (ot - ol)) / (nt - nl)) / nt, 9) AS impurity FROM w{k} WHERE after IS NOT NULL AND nl >= {min_leaf} AND nt - nl >= {min_leaf}),
s{k} AS (SELECT {by}, node, feature::INTEGER AS feature, CASE WHEN value / 2 + after / 2 > value AND value / 2 + after / 2 <= after THEN value / 2 + after / 2 ELSE after END AS threshold
  FROM i{k} QUALIFY row_number() OVER (PARTITION BY {by}, node ORDER BY impurity, feature, value) = 1),
n{k} AS (SELECT {by}, node, feature, threshold, n, ones FROM c{k} LEFT JOIN s{k} USING ({by}, node))""")
        rows = f"SELECT {by}, v, y, 2 * node + (NOT v[feature + 1] < threshold)::BIGINT AS node FROM r{k} JOIN s{k} USING ({by}, node)"
    sql.append(f"n{depth} AS (SELECT {by}, node, NULL::INTEGER AS feature, NULL::DOUBLE AS threshold, count(*) AS n, sum(y)::BIGINT AS ones FROM ({rows}) GROUP BY ALL)")
    sql.append(f"nodes AS (SELECT {by}, node, feature, threshold, (2 * ones > n)::INTEGER AS action, n, ones FROM ({' UNION ALL '.join(f'SELECT * FROM n{k}' for k in range(depth + 1))}))")
    return ",\n".join(sql)


def _walk_sql(rows: str, by: str, depth: int) -> str:
    """CTEs up to `ended`: the rows of `rows` (by, v, ...) with the node `spot` where they end and its action."""
    sql = [f"e0 AS (SELECT *, 1::BIGINT AS spot FROM ({rows}))"]
    for k in range(depth):
        step = "CASE WHEN n.feature IS NULL THEN e.spot WHEN e.v[n.feature + 1] < n.threshold THEN 2 * e.spot ELSE 2 * e.spot + 1 END AS spot"
        sql.append(f"e{k + 1} AS (SELECT e.* EXCLUDE (spot), {step} FROM e{k} e JOIN nodes n ON {' AND '.join(f'n.{c} = e.{c}' for c in by.split(', '))} AND n.node = e.spot)")
    sql.append(f"ended AS (SELECT e.*, n.action FROM e{depth} e JOIN nodes n ON {' AND '.join(f'n.{c} = e.{c}' for c in by.split(', '))} AND n.node = e.spot)")
    return ",\n".join(sql)


_STREAM_SQL = f"""{r.EVENTS_SQL},
stream AS (SELECT user_id, event_id, seq, y, [value, hour(ts)::DOUBLE, coalesce(lag(y) OVER w, 0)::DOUBLE, coalesce(lag(value) OVER w, 0)] AS v
  FROM events_in_order WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
refits AS (SELECT user_id, unnest(range(0, (n - {WARMUP}) // EVERY_ROWS + 1)) AS refit, {WARMUP} + refit * EVERY_ROWS AS fitted_at FROM (SELECT user_id, max(seq) + 1 AS n FROM stream GROUP BY 1) WHERE n >= {WARMUP})"""
_TRAIN = f"SELECT user_id, refit, v, y FROM stream JOIN refits USING (user_id) WHERE seq < fitted_at AND (refit = 0 OR seq >= fitted_at - {WINDOW})"
_ASKED = f"SELECT s.*, (seq - {WARMUP}) // EVERY_ROWS AS refit, fitted_at FROM stream s JOIN refits f ON f.user_id = s.user_id AND f.refit = (seq - {WARMUP}) // EVERY_ROWS WHERE seq >= {WARMUP}"


def _prequential_sql(every: int) -> str:
    return f"{_STREAM_SQL},\n{_forest_sql(_TRAIN, 'user_id, refit', DEPTH, MIN_LEAF)},\n{_walk_sql(_ASKED, 'user_id, refit', DEPTH)}".replace("EVERY_ROWS", str(every))


#: Without refits there is one tree: the next one would be fitted beyond any number of rows.
NEVER = 1 << 40
_LOSSES = "SELECT user_id, '{}' AS method, count(*) AS prediction_calls, count(DISTINCT refit) AS trees, sum((action <> y)::INTEGER)::BIGINT AS loss_sum, round(avg((action <> y)::INTEGER), 9) AS mean_loss FROM ended GROUP BY user_id"


# ---- populations over rows ----


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return r._t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 5).cast("int").alias("y"))


def _population(spark: SparkSession, d: str) -> DataFrame:
    """Node tables of trees that each learned from one share of the rows."""
    return forests.grow_nodes(_rows(spark, d).withColumn("tree", F.col("vec_id") % TREES), ["tree"], "x", "y", TREE_DEPTH, TREE_LEAF)


def _leaves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _population(spark, d)
    return forests.leaf_counts(_rows(spark, d), nodes, "tree", "x", "y"), nodes


def _one_tree(spark: SparkSession, d: str) -> DataFrame:
    return forests.grow_nodes(_rows(spark, d), [], "x", "y", TREE_DEPTH, TREE_LEAF)


def template_cart(spark: SparkSession, d: str) -> DataFrame:
    """The shape of the tree of all rows, refitted to each share of them with a few cuts of each feature."""
    cuts = trees.candidate_thresholds(r._features(spark, d), SLOTS)
    found = forests.refit_template(_rows(spark, d).withColumn("tree", F.col("vec_id") % TREES), ["tree"], "x", "y", _one_tree(spark, d), cuts, TREE_DEPTH, TREE_LEAF)
    return found.withColumn("threshold", F.round("threshold", 9))


def tree_predict_case(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("vec_id", trees.predict(forests.nested(_one_tree(spark, d)), "x").alias("pred"))


def path_reach(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where(forests.reaches(_one_tree(spark, d), PATH, "x")).select("vec_id", "y")


_ROWS_SQL = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (label < 5)::INTEGER AS y FROM embeddings"
_POPULATION_SQL = _forest_sql(f"SELECT vec_id % {TREES} AS tree, v, y FROM ({_ROWS_SQL})", "tree", TREE_DEPTH, TREE_LEAF)
_ONE_SQL = _forest_sql(f"SELECT 0 AS one, v, y FROM ({_ROWS_SQL})", "one", TREE_DEPTH, TREE_LEAF)
_ONE_WALK = _walk_sql(f"SELECT 0 AS one, * FROM ({_ROWS_SQL})", "one", TREE_DEPTH)
_SITES_SQL = f"""{_POPULATION_SQL},
{_walk_sql(f"SELECT * FROM ({_ROWS_SQL}), (SELECT DISTINCT tree FROM nodes)", "tree", TREE_DEPTH)},
held AS (SELECT tree, spot >> k AS node, y, action FROM ended, range({TREE_DEPTH + 1}) s(k) WHERE spot >> k >= 1),
shape AS (SELECT tree, node >> k AS node, count(*) AS node_count, max(floor(log2(node)))::BIGINT - floor(log2(node >> k))::BIGINT AS subtree_depth FROM nodes, range({TREE_DEPTH + 1}) s(k) WHERE node >> k >= 1 GROUP BY tree, node >> k),
sums AS (SELECT tree, node, count(*) AS reached, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0 AND action = 0) AS r0, count(*) FILTER (y = 1 AND action = 1) AS r1 FROM held GROUP BY ALL),
sites AS (
  SELECT tree, node, node_count, subtree_depth, coalesce(reached, 0) AS reached, round(reached / (SELECT count(*) FROM embeddings), 9) AS reach_rate, round((reached - r0 - r1) / reached, 9) AS local_error,
         round(CASE WHEN zeros = 0 OR ones = 0 THEN (reached - r0 - r1) / reached ELSE 1 - 0.5 * (r0 / zeros + r1 / ones) END, 9) AS balanced_error, (coalesce(zeros, 0) = 0 OR coalesce(ones, 0) = 0)::INTEGER AS class_deficient
  FROM shape LEFT JOIN sums USING (tree, node))"""


def _template_sql() -> str:
    """CTEs up to `refitted`: the shape of the one tree, the cuts of all rows, and the levels of each share's tree."""
    sql, rows = [], f"SELECT vec_id % {TREES} AS tree, v, y, 1::BIGINT AS node FROM ({_ROWS_SQL})"
    gini = lambda n, o: f"2 * {o} * ({n} - {o}) / ({n})"
    for k in range(TREE_DEPTH):
        sql.append(f"""tr{k} AS ({rows}),
tc{k} AS (SELECT tree, node, count(*) AS n, sum(y)::BIGINT AS ones FROM tr{k} GROUP BY ALL),
te{k} AS (SELECT a.tree, a.node, s.feature, cut, slot, n, ones, count(*) AS nl, sum(y)::BIGINT AS ol FROM tr{k} a JOIN tc{k} USING (tree, node) JOIN shape s ON s.node = a.node JOIN cuts c ON c.feature = s.feature
  WHERE v[s.feature + 1] < cut AND ones > 0 AND ones < n AND n >= {2 * TREE_LEAF} GROUP BY ALL),
ti{k} AS (SELECT *, round(({gini('nl', 'ol')} + {gini('(n - nl)', '(ones - ol)')}) / n, 9) AS impurity FROM te{k} WHERE nl >= {TREE_LEAF} AND n - nl >= {TREE_LEAF}),
ts{k} AS (SELECT tree, node, feature, cut AS threshold FROM ti{k} WHERE {gini('n', 'ones')} / n - impurity > 1e-12::DOUBLE QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY impurity, slot) = 1),
tn{k} AS (SELECT tree, node, feature, threshold, n, ones FROM tc{k} LEFT JOIN ts{k} USING (tree, node))""")
        rows = f"SELECT tree, v, y, 2 * node + (NOT v[feature + 1] < threshold)::BIGINT AS node FROM tr{k} JOIN ts{k} USING (tree, node)"
    sql.append(f"tn{TREE_DEPTH} AS (SELECT tree, node, NULL::INTEGER AS feature, NULL::DOUBLE AS threshold, count(*) AS n, sum(y)::BIGINT AS ones FROM ({rows}) GROUP BY ALL)")
    sql.append(f"refitted AS (SELECT tree, node, feature, round(threshold, 9) AS threshold, (2 * ones >= n)::INTEGER AS action, n, ones FROM ({' UNION ALL '.join(f'SELECT * FROM tn{k}' for k in range(TREE_DEPTH + 1))}))")
    return f"""{_ONE_SQL},
shape AS (SELECT node, feature FROM nodes WHERE feature IS NOT NULL),
{r.FEATURES_SQL},
listed AS (SELECT feature, list_sort(list(DISTINCT value)) AS vs FROM long GROUP BY feature),
slotted AS (SELECT feature, vs, len(vs) - 1 AS gaps, unnest(range(1, least({SLOTS}, len(vs) - 1) + 1)) AS slot FROM listed),
pairs AS (SELECT feature, slot, vs[place + 1] AS a, vs[place + 2] AS b FROM (SELECT *, slot * gaps // (least({SLOTS}, gaps) + 1) AS place FROM slotted)),
cuts AS (SELECT feature, cut, min(slot) AS slot FROM (SELECT feature, slot, CASE WHEN a / 2 + b / 2 > a AND a / 2 + b / 2 <= b THEN a / 2 + b / 2 ELSE b END AS cut FROM pairs) GROUP BY ALL),
{", ".join(sql)}"""


QUERIES: dict[str, r.Query] = {
    "rolling_cart": rolling_cart,
    "frozen_cart": frozen_cart,
    "cart_control_losses": cart_control_losses,
    "population_scores": lambda s, d: forests.population_scores(*_leaves(s, d), "tree"),
    "tree_sites": lambda s, d: forests.sites(*_leaves(s, d), "tree"),
    "population_nodes": lambda s, d: _population(s, d).withColumn("threshold", F.round("threshold", 9)),
    "template_cart": template_cart,
    "tree_predict_case": tree_predict_case,
    "path_reach": path_reach,
}

ORACLE_SQL: dict[str, str] = {
    "rolling_cart": f"WITH {_prequential_sql(EVERY)}\nSELECT user_id, event_id, refit, fitted_at, action AS pred, y FROM ended",
    "frozen_cart": f"WITH {_prequential_sql(NEVER)}\nSELECT user_id, event_id, action AS pred, y FROM ended",
    "cart_control_losses": f"SELECT * FROM (WITH {_prequential_sql(NEVER)}\n{_LOSSES.format('FROZEN_CART')}) UNION ALL SELECT * FROM (WITH {_prequential_sql(EVERY)}\n{_LOSSES.format('ROLLING_CART')})",
    "population_scores": f"WITH {_SITES_SQL}\nSELECT tree, node_count AS nodes, round(1 - local_error, 9) AS accuracy, round(1 - balanced_error - 0.00025 * node_count, 9) AS fitness, class_deficient FROM sites WHERE node = 1",
    "tree_sites": f"WITH {_SITES_SQL}\nSELECT * FROM sites",
    "population_nodes": f"WITH {_POPULATION_SQL}\nSELECT * REPLACE (round(threshold, 9) AS threshold) FROM nodes",
    "template_cart": f"WITH {_template_sql()}\nSELECT * FROM refitted",
    "tree_predict_case": f"WITH {_ONE_SQL},\n{_ONE_WALK}\nSELECT vec_id, action AS pred FROM ended",
    "path_reach": f"WITH {_ONE_SQL},\n{_ONE_WALK}\nSELECT vec_id, y FROM ended WHERE spot >> (floor(log2(spot))::BIGINT - {len(PATH)}) = 5",
}
