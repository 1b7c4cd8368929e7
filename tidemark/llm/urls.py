"""Operator 10: URL filters that follow redirects and canonical links.

An address is a page's host, path and query; scheme and fragment name no other page. A page's canonical link and its
refresh redirect join its address with the target's. Connected components over these edges are the sets of aliases.
Everything here is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import store

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, f"(?s)^.*?://{pattern}", 1), F.lit(""))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(_part(url, "([^/?#]*)"), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return _part(url, "[^/?#]*([^?#]*)")


def url_address(url: Column) -> Column:
    """Host, path and query; null where there is no `://`."""
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), _part(url, "[^/?#]*([^#]*)")))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; of rules as long as each other, allow comes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(under))
        rule, verdict = F.when(fits, at + under).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


#: Tags end at the next bracket of either kind, so that one which never closes is not searched to the text's end.
_LINK, _META = r"(?is)<link\b[^<>]*>", r"(?is)<meta\b[^<>]*>"
_CANONICAL, _REFRESH = r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF, _URL = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def _targets(html: Column) -> Column:
    """The targets of all canonical links and refresh redirects of a page."""

    def found(tag: str, mark: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark))
        return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, target, 1), F.lit("&amp;"), F.lit("&")))

    return F.concat(found(_LINK, _CANONICAL, _HREF), found(_META, _REFRESH, _URL))


def _settled(way: Column) -> Column:
    """A path (with its query) without `.` and `..` segments; a `..` at the top goes nowhere."""
    path = F.regexp_extract(way, "(?s)^([^?#]*)", 1)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    settled = F.concat(F.array_join(F.concat(kept, last), "/"), F.regexp_extract(way, "(?s)^[^?#]*(.*)$", 1))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), settled).otherwise(way)


def _whole(target: Column, host: Column, path: Column) -> Column:
    """A link's target as a whole URL, as seen from a page; null for an anchor, an empty one, or another scheme such as mailto."""
    here = F.concat(F.lit("http://"), host)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when((target == "") | F.startswith(target, F.lit("#")) | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(here, _settled(target)))
        .when(F.startswith(target, F.lit("?")), F.concat(here, path, target))
        .otherwise(F.concat(here, _settled(F.concat(folder, target))))
    )


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict.

    A page's own rule decides it. Without one it takes its aliases' word: allow if a rule allows one of them, else block
    if a rule blocks one of them, else allow. Targets are whole URLs, `//host/...`, or relative to the page's folder, with `.` and
    `..` resolved; `&amp;` is read as `&`. Anchors and other schemes make no edge.
    Targets that are no pages here are judged as aliases too. Null URLs, or URLs without `://`, have empty host and path,
    fit no rule and have no alias; null html makes no edge. Repeated rows are each answered; other columns are not read.
    Rows whose own address has no edge never meet the components' shuffle.
    """
    own = url_address(F.col("url"))
    edges = pages.select(own.alias("a"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.explode(_targets(F.col("html"))).alias("to")).where("a is not null")
    edges = store(edges.select("a", url_address(_whole(F.col("to"), F.col("host"), F.col("path"))).alias("b")).where("b is not null").distinct())
    aliases = connected_components(edges)
    # An address holds its host up to the first `/` or `?`, and its path up to `?`.
    _, said = match_rule(F.regexp_extract("node", "(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules)
    told = aliases.withColumn("said", said)
    words = told.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    words = words.where("blocked and not coalesce(allowed, false)").select("component")
    blocked = store(told.where("said is null").join(store(words), "component").select(F.col("node").alias("address")))

    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), own.alias("address"))
    judged = judged.withColumn("rule", rule).withColumn("own", verdict)
    judged = judged.join(blocked.withColumn("by_alias", F.lit(True)), "address", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("by_alias"), "block").otherwise("allow")).alias("verdict"))


def _sql_rule(host: str, path: str, what) -> str:
    whens = " ".join(f"WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') THEN '{what(r)}'" for r in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow")))
    return f"CASE {whens} END"


def _settled_sql(way: str) -> str:
    path = f"regexp_extract({way}, '(?s)^([^?#]*)', 1)"
    parts = f"list_transform(string_split({path}, '/'), lambda s: [s])"
    kept = f"list_reduce({parts}, lambda k, s: CASE s[1] WHEN '..' THEN k[1:greatest(len(k) - 1, 1)] WHEN '.' THEN k ELSE list_concat(k, s) END)"
    last = f"CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE [] END"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN array_to_string(list_concat({kept}, {last}), '/') || regexp_extract({way}, '(?s)^[^?#]*(.*)$', 1) ELSE {way} END"


URL_SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail
  FROM pages),
named AS (SELECT *, CASE WHEN contains(url, '://') THEN host || tail END AS address FROM parts),
targets AS (
  SELECT address, host, path, replace(unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^<>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^<>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))), '&amp;', '&') AS target
  FROM named WHERE address IS NOT NULL),
whole AS (
  SELECT address, CASE WHEN contains(target, '://') THEN target
      WHEN target = '' OR starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || host || {_settled_sql("target")}
      WHEN starts_with(target, '?') THEN 'http://' || host || path || target
      ELSE 'http://' || host || {_settled_sql("(coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || target)")} END AS target
  FROM targets),
edges AS (
  SELECT DISTINCT address AS a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') || regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM whole WHERE contains(target, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
said AS (
  SELECT a, {_sql_rule("regexp_extract(b, '(?s)^([^/?]*)', 1)", "regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1)", lambda r: r[0])} AS verdict FROM reach),
told AS (SELECT a, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM said GROUP BY a)
SELECT page_id, host, path, {_sql_rule("host", "path", lambda r: r[1] + r[2])} AS rule,
       coalesce({_sql_rule("host", "path", lambda r: r[0])}, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN told ON address = a
"""
