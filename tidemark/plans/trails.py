"""Registered queries of provenance: copy chains, rules of a log, forks, parents-first orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lineage, provenance
from tidemark.plans import registry as r

#: Binary digits of the longest chain that the SQL covers.
ROUNDS = 17


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Customers as copies of one a few numbers before; some name a source that isn't there."""
    c = F.col("c_custkey")
    back = c - c % 7 - 1
    return r._t(spark, d, "customer").select(c.alias("id"), F.when(c % 97 == 5, -c).when(back >= 1, back).alias("source"))


LINKS_SQL = """links AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 5 THEN -c_custkey WHEN c_custkey - c_custkey % 7 - 1 >= 1 THEN c_custkey - c_custkey % 7 - 1 END AS source FROM customer)"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines as a log: parts are copied between lines of one supplier; lines without discount are a trusted boundary."""
    lines = r._t(spark, d, "lineitem")
    name = lambda k: F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), k.cast("string"))
    log = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
        F.when(F.col("l_linenumber") % 2 == 1, "edge").otherwise("node").alias("kind"),
        name(F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_quantity") > 25, name(F.col("l_linenumber") + F.when(F.col("l_linestatus") == "F", 0).otherwise(2))).alias("source"),
        F.concat(F.lit("t"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("token"),
        F.col("l_linestatus").alias("mode"),
    )
    trusted = lines.where("l_discount = 0").select(name(F.col("l_linenumber") + 1).alias("id"))
    return log, trusted


LOG_SQL = """log AS (
  SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'edge' ELSE 'node' END AS kind, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id,
         CASE WHEN l_quantity > 25 THEN l_partkey || '-' || l_suppkey || '-' || (l_linenumber + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END) END AS source,
         't' || l_partkey || l_returnflag AS token, l_linestatus AS mode
  FROM lineitem),
trusted AS (SELECT DISTINCT l_partkey || '-' || l_suppkey || '-' || (l_linenumber + 1) AS id FROM lineitem WHERE l_discount = 0)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers with parents at a half and a third of their number; some halves wait for their double, which is a cycle."""
    c = F.col("c_custkey")
    nodes = r._t(spark, d, "customer").select(c.alias("node"))
    back = r._t(spark, d, "customer").where(c % 40 == 7).select(c.alias("child"), (2 * c).alias("parent"))
    return nodes, lineage.edges(r._lineage(spark, d)).unionByName(back)


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as forks of their order's first line, which saves at two places."""
    first = F.col("l_linenumber") == 1
    number = lambda line: (F.col("l_orderkey") * 8 + line).cast("long")
    return r._t(spark, d, "lineitem").select(
        number(F.col("l_linenumber")).alias("id"), F.when(~first, number(F.lit(1))).alias("parent_id"), (F.col("l_partkey") % 4).alias("start"),
        F.when(first, F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 4)).alias("checkpoints"), "l_linestatus", "l_returnflag",
    )


def _doubled_sql() -> str:
    """CTEs d0.. of the digest of the first 2^k nodes of each chain, and the node after them."""
    sql = ["d0 AS MATERIALIZED (SELECT l.id, s.id AS next, sha256(l.id::VARCHAR) AS digest FROM links l LEFT JOIN links s ON s.id = l.source)"]
    for k in range(ROUNDS):
        sql.append(f"d{k + 1} AS MATERIALIZED (SELECT a.id, b.next, CASE WHEN a.next IS NULL THEN a.digest ELSE sha256(a.digest || b.digest) END AS digest FROM d{k} a LEFT JOIN d{k} b ON b.id = a.next)")
    return ",\n".join(sql)


QUERIES: dict[str, r.Query] = {
    "copy_chains": lambda s, d: provenance.chains(_links(s, d)),
    "copy_violations": lambda s, d: provenance.copy_violations(_log(s, d)[0], ["mode"], _log(s, d)[1]),
    "parents_first": lambda s, d: provenance.parents_first(*_graph(s, d)),
    "fork_violations": lambda s, d: provenance.fork_violations(_tasks(s, d), ["l_linestatus", "l_returnflag"]),
}

ORACLE_SQL: dict[str, str] = {
    "copy_chains": f"""WITH RECURSIVE {LINKS_SQL},
walk AS (SELECT id, 0::BIGINT AS n, id AS here FROM links UNION ALL SELECT w.id, n + 1, s.id FROM walk w JOIN links l ON l.id = w.here JOIN links s ON s.id = l.source),
ends AS (SELECT id, max(n) AS chain_length, arg_max(here, n) AS "end" FROM walk GROUP BY id),
{_doubled_sql()}
SELECT e.id, chain_length, "end", digest, CASE WHEN l.source IS NULL THEN 'ok' ELSE 'missing' END AS status FROM ends e JOIN d{ROUNDS} USING (id) JOIN links l ON l.id = e."end\"""",
    "copy_violations": f"""WITH {LOG_SQL},
held AS (SELECT kind, id, min(seq) AS first, arg_min(token, seq) AS token, arg_min(mode, seq) AS mode FROM log GROUP BY ALL),
minted AS (SELECT token, min(seq) AS first FROM log WHERE source IS NULL GROUP BY ALL),
seen AS (
  SELECT e.*, o.first AS own_first, h.first AS old_first, h.token AS old_token, h.mode AS old_mode, m.first AS minted_first, e.source IN (SELECT id FROM trusted) AS trusted_source, e.id IN (SELECT id FROM trusted) AS trusted_id
  FROM log e JOIN held o ON o.kind = e.kind AND o.id = e.id LEFT JOIN held h ON h.kind = e.kind AND h.id = e.source LEFT JOIN minted m ON m.token = e.token),
ruled AS (SELECT seq, kind, id, unnest(list_filter([
    CASE WHEN seq > own_first OR trusted_id THEN 'repeated_id' END,
    CASE WHEN source IS NOT NULL AND NOT coalesce(old_first < seq, false) AND NOT trusted_source THEN 'absent_source' END,
    CASE WHEN source IS NOT NULL AND old_first < seq AND (token IS DISTINCT FROM old_token OR mode IS DISTINCT FROM old_mode) THEN 'altered_copy' END,
    CASE WHEN source IS NULL AND minted_first < seq THEN 'reused_token' END], lambda x: x IS NOT NULL)) AS rule FROM seen)
SELECT * FROM ruled""",
    "parents_first": f"""WITH RECURSIVE {r.LINEAGE_SQL.replace("edges AS", "own AS")},
nodes AS (SELECT DISTINCT c_custkey AS node FROM customer),
edges AS (SELECT * FROM own UNION SELECT node, 2 * node FROM nodes WHERE node % 40 = 7 AND 2 * node IN (SELECT node FROM nodes)),
up(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor),
looped AS (SELECT node FROM up WHERE node = ancestor),
stuck AS (SELECT DISTINCT node FROM up WHERE ancestor IN (SELECT node FROM looped)),
between AS (SELECT DISTINCT ancestor AS node FROM up WHERE node IN (SELECT node FROM looped) AND ancestor IN (SELECT node FROM stuck)),
down(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM edges) UNION SELECT e.child, down.level + 1 FROM down JOIN edges e ON e.parent = down.node WHERE e.child NOT IN (SELECT node FROM stuck)),
levels AS (SELECT node, max(level) AS level FROM down GROUP BY node)
SELECT node, level, row_number() OVER (ORDER BY level, node) AS place, 'ordered' AS status FROM levels
UNION ALL SELECT node, NULL, NULL, CASE WHEN node IN (SELECT node FROM between) THEN 'cycle' ELSE 'behind' END FROM stuck""",
    "fork_violations": """WITH tasks AS (
  SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS id, CASE WHEN l_linenumber > 1 THEN (l_orderkey * 8 + 1)::BIGINT END AS parent_id, l_partkey % 4 AS start, l_suppkey % 4 AS second, l_linestatus, l_returnflag FROM lineitem),
parents AS (SELECT * FROM tasks WHERE parent_id IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY start, second, l_linestatus, l_returnflag) = 1),
joined AS (SELECT t.id, p.id IS NULL AS absent, NOT (t.start IN (p.start, p.second)) AS elsewhere, t.l_linestatus <> p.l_linestatus OR t.l_returnflag <> p.l_returnflag AS other FROM tasks t LEFT JOIN parents p ON p.id = t.parent_id WHERE t.parent_id IS NOT NULL)
SELECT id, 'absent_parent' AS rule FROM joined WHERE absent UNION ALL SELECT id, 'no_checkpoint' FROM joined WHERE elsewhere UNION ALL SELECT id, 'other_stream' FROM joined WHERE other
UNION ALL SELECT id, 'repeated' FROM tasks GROUP BY id HAVING count(*) > 1""",
}
