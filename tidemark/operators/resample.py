"""Whole-stream bootstrap, stratified by scenario, from addressed draws; Holm's step-down."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from tidemark.operators.stored import store


#: Realisations by number that are ordered in one task.
RANGE = 4096


#: Draws made at once (few enough for a core's cache), draws of a group of replicates at least, members of a group at most, draws of a task that wait to be counted, and members in a row when they are copied.
DRAWS, GROUP, BLOCK, HELD, PACK = 1 << 12, 1 << 20, 1 << 21, 1 << 22, 1 << 10


def resampled(at: DataFrame, columns: dict[str, Column], replicates: int, name: str | Column, *by: str) -> DataFrame:
    """(b, by, scenario, n, and a sum for each column) of each replicate: as many draws as the scenario has members, each by its address.

    `at` is `placed`, by the same `by`; the columns are made of it and are whole numbers, so that sums don't depend on order.
    Samples of several `by` have draws of their own if the name is made of it, and are drawn in one job. The members of a
    scenario are copied to each group of its replicates, many to a row, and the group's draws are made where its members
    are: draws are neither shuffled nor kept. Groups have much the same number of draws and are numbered, so that each has a task of its
    own. A scenario of more than BLOCK members is dealt by places, and each block takes the draws that fall into it. The
    sums are stored: the draws are one job of their own, so that no broadcast of what is made of them waits for them past
    its timeout, and no later plan makes them again.
    """
    keys = [*by, "scenario"]
    name = F.lit(name) if isinstance(name, str) else name.cast("string")
    at = at.select(*keys, name.alias("name"), "place", *(F.coalesce(c, F.lit(0)).alias(k) for k, c in columns.items()))
    spark = at.sparkSession
    rows, strata = at.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
    tasks = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    target = max(GROUP, ceil(rows * replicates / tasks))
    dealt = min(ceil(rows * replicates / target) + strata, 4 * tasks) or 1
    turns, blocks = F.least(F.ceil(F.col("size") * F.lit(replicates) / target), F.lit(replicates)), F.ceil(F.col("size") / BLOCK)
    sizes = at.groupBy(*keys).agg(F.count("*").alias("size")).withColumn("width", F.ceil(replicates / turns).cast("long"))
    turns = F.ceil(replicates / F.col("width"))
    earlier = F.coalesce(F.sum(turns * blocks).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each scenario
    upto = lambda last, c: F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias(c)
    groups = sizes.withColumn("earlier", earlier).select("*", upto(turns - 1, "turn")).select("*", upto(blocks - 1, "block"))
    task = F.pmod(F.col("earlier") + F.col("turn") * blocks + F.col("block"), F.lit(dealt)).cast("int")
    packs = at.groupBy(*keys, "name", F.floor(F.col("place") / BLOCK).alias("block"), F.floor(F.col("place") % BLOCK / PACK).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("m"))
    packs = packs.select(*keys, "name", "block", "pack", *(F.col("m")[c].alias(c) for c in columns))
    members = packs.join(groups.withColumn("task", task), [*keys, "block"])  # a row for each group of replicates
    parts = members.repartitionById(dealt, "task").groupBy("task", *keys, "turn", "block").applyInArrow(*_drawn_sums(at, keys, list(columns), replicates))
    return store(parts.groupBy("b", *keys).agg(*(F.sum(c).alias(c) for c in ("n", *columns))))


def _places(ahead: bytes, draws: list[bytes], size: int) -> np.ndarray:
    """The upper 53 bits of SHA-256 of each draw's address, modulo the scenario's size."""
    start, found = sha256(ahead).copy, []
    for i in draws:
        state = start()
        state.update(i)
        found.append(state.digest())
    return (np.frombuffer(b"".join(found), ">u8")[::4].astype(np.uint64) >> np.uint64(11)).astype(np.int64) % size


def _fallen(values: list[np.ndarray], place: np.ndarray) -> list[int | float]:
    """The sum of each column over the places drawn: many draws are counted by member, so that columns are read in order."""
    if not values or len(values[0]) > 2 * len(place):
        return [v[place].sum().item() if len(place) else 0 for v in values]
    times = np.bincount(place, minlength=len(values[0]))
    whole = lambda v: np.issubdtype(v.dtype, np.integer) or np.isfinite(v).all()
    return [(v @ times.astype(v.dtype) if whole(v) else v[place].sum()).item() for v in values]


def _drawn_sums(at: DataFrame, keys: list[str], columns: list[str], replicates: int) -> tuple[Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table], str]:
    """What makes the draws of a group of replicates and sums up those members of a block that they fall on, and its schema."""
    kinds = {c: at.schema[c].dataType for c in (*keys, *columns)}
    out = {"b": LongType(), **{k: kinds[k] for k in keys}, "n": LongType(), **{c: kinds[c] for c in columns}}
    types = [to_arrow_type(k) for k in out.values()]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own, turn, block = [k.as_py() for k in key[1:-2]], *(k.as_py() for k in key[-2:])
        size, width, name = (table[c][0].as_py() for c in ("size", "width", "name"))
        table = table.sort_by("pack")
        values = [pc.list_flatten(table[c]).to_numpy() for c in columns]
        bs, whole = range(turn * width, min((turn + 1) * width, replicates)), size <= BLOCK
        sums = [[0] * (1 + len(columns)) for _ in bs]
        held = min(size, max(HELD // 16, 1))
        step = max(HELD // held, 1)
        for first in range(0, len(bs), step):
            some = range(first, min(first + step, len(bs)))
            for begin in range(0, size, held):
                places = np.empty((len(some), min(held, size - begin)), np.int64)
                for low in range(0, places.shape[1], DRAWS):
                    draws = [b"%d" % i for i in range(begin + low, begin + min(low + DRAWS, places.shape[1]))]
                    for j, k in enumerate(some):
                        places[j, low : low + len(draws)] = _places(f"{name}|{bs[k]}|{own[-1]}|".encode(), draws, size)
                for place, k in zip(places, some, strict=True):
                    if not whole:
                        place = place[place // BLOCK == block] - block * BLOCK
                    sums[k] = [a + b for a, b in zip(sums[k], (len(place), *_fallen(values, place)), strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((bs, *([k] * len(bs) for k in own), *zip(*sums, strict=True)), types, strict=True)], list(out))

    return run, ", ".join(f"`{c}` {k.simpleString()}" for c, k in out.items())


def placed(df: DataFrame, *by: str) -> DataFrame:
    """Add each row's 0-based place among its scenario's realisations (of each `by`), which are numbered, and store the table.

    Rows are stored before they are counted, so that `df` is made once. Only realisations of one range of numbers are ordered together; ranges' counts are summed up, so no scenario gathers
    in one task.
    """
    keys = [*by, "scenario"]
    dealt = store(df).withColumn("range", F.floor(F.col("realisation") / RANGE))
    counts = dealt.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("realisation"))
    return store(dealt.withColumn("inside", inside).join(counts.select(*keys, "range", before.alias("before")), [*keys, "range"]).withColumn("place", F.col("before") + F.col("inside") - 1).drop("range", "inside", "before"))


def _spread(cells: DataFrame, *by: str) -> DataFrame:
    """(by, theta, se): equal-scenario mean and stratified standard error from each scenario's n, s and ss, which are integers."""
    mean, variance = F.col("s") / F.col("n"), (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return cells.select(*by, mean.alias("m"), (variance / F.col("n")).alias("v")).groupBy(*by).agg(F.avg("m").alias("theta"), (F.sqrt(F.sum("v")) / F.count("*")).alias("se"))


def _summed(df: DataFrame, columns: dict[str, Column], *by: str) -> DataFrame:
    """The sums of all rows of each scenario, as `resampled` has them for a replicate."""
    return df.groupBy(*by, "scenario").agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in columns.items()))


def _powers(values: list[str]) -> dict[str, Column]:
    return {k: c for v in values for k, c in ((f"s_{v}", F.col(v).cast("long")), (f"ss_{v}", F.col(v).cast("long") * F.col(v).cast("long")))}


def _each(cells: DataFrame, values: list[str], *by: str) -> DataFrame:
    """(contrast, by, theta, se) of several columns whose sums were made together."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("contrast"), F.col(f"s_{v}").alias("s"), F.col(f"ss_{v}").alias("ss")) for v in values)))
    return _spread(cells.select(*by, "n", each.alias("c")).select(*by, "n", "c.*"), "contrast", *by)


def whole_moments(at: DataFrame, values: list[str]) -> DataFrame:
    """(contrast, theta, se) of integer-valued panel columns."""
    return _each(_summed(at, _powers(values)), values)


def replicate_moments(at: DataFrame, values: list[str], n: int, name: str) -> DataFrame:
    """(contrast, b, theta, se) of each replicate; all columns share its draws. `at` is `placed`."""
    return _each(resampled(at, _powers(values), n, name), values, "b")


def replicates(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """(b, theta, se) of each replicate of an integer-valued panel column."""
    return replicate_moments(placed(df.select("scenario", "realisation", value)), [value], n, name).drop("contrast")


def bootstrap_t(df: DataFrame, value: str, n: int, name: str, level: float = 0.95) -> DataFrame:
    """Symmetric bootstrap-t: estimate, standard error, critical value (an order statistic), interval, p-value.

    A replicate without variance counts as a pivot of +infinity.
    """
    at = placed(df.select("scenario", "realisation", value))
    whole = whole_moments(at, [value]).drop("contrast").withColumnsRenamed({"theta": "estimate", "se": "se_0"})
    pivots = replicate_moments(at, [value], n, name).crossJoin(F.broadcast(whole)).select("estimate", "se_0", F.when(F.col("se") == 0, float("inf")).otherwise(F.abs(F.col("theta") - F.col("estimate")) / F.col("se")).alias("t"))
    out = pivots.groupBy("estimate", "se_0").agg(F.element_at(F.array_sort(F.collect_list("t")), ceil(round(level * (n + 1), 9))).alias("critical"), F.count_if(F.col("t") >= F.abs("estimate") / F.col("se_0")).alias("beyond"))
    reach = F.col("critical") * F.col("se_0")
    return out.select(F.round("estimate", 6).alias("estimate"), F.round("se_0", 6).alias("se"), F.round("critical", 6).alias("critical"), F.round(F.col("estimate") - reach, 6).alias("low"), F.round(F.col("estimate") + reach, 6).alias("high"), F.round((1 + F.col("beyond")) / (n + 1), 6).alias("p"))


def percentile_interval(df: DataFrame, value: str, n: int, name: str, level: float = 0.95) -> DataFrame:
    """Order statistics of the replicates' means, ranks (1 - level) / 2, rounded down, and (1 + level) / 2, rounded up, of n + 1."""
    low, high = floor((1 - level) / 2 * (n + 1) + 1e-9), ceil((1 + level) / 2 * (n + 1) - 1e-9)
    ordered = F.array_sort(F.collect_list("theta"))
    return replicates(df, value, n, name).agg(F.round(F.element_at(ordered, max(low, 1)), 6).alias("low"), F.round(F.element_at(ordered, min(high, n)), 6).alias("high"))


def max_t(df: DataFrame, values: list[str], n: int, name: str, level: float = 0.95) -> DataFrame:
    """Simultaneous intervals: one critical value, the quantile (next higher order statistic) of each replicate's largest |t|.

    All columns share a replicate's draws; a replicate without variance has t = 0 here.
    """
    at = placed(df.select("scenario", "realisation", *values))
    whole = whole_moments(at, values).withColumnsRenamed({"theta": "estimate", "se": "se_0"})
    t = replicate_moments(at, values, n, name).join(whole, "contrast").select("b", F.when(F.col("se") == 0, 0.0).otherwise(F.abs(F.col("theta") - F.col("estimate")) / F.col("se")).alias("t"))
    critical = t.groupBy("b").agg(F.max("t").alias("t")).agg(F.element_at(F.array_sort(F.collect_list("t")), ceil(level * (n - 1)) + 1).alias("critical"))
    reach = F.col("critical") * F.col("se_0")
    return whole.crossJoin(F.broadcast(critical)).select("contrast", F.round("estimate", 6).alias("estimate"), F.round("critical", 6).alias("critical"), F.round(F.col("estimate") - reach, 6).alias("low"), F.round(F.col("estimate") + reach, 6).alias("high"))


def holm(tests: DataFrame, name: str, p: str, *family: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values (a running maximum) and rejections, within each family."""
    order = Window.partitionBy(*family).orderBy(p, name)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stepped = tests.withColumn("step", F.least((F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p), F.lit(1.0)))
    adjusted = stepped.withColumn("adjusted", F.max("step").over(upto))
    return adjusted.select(*family, name, p, F.round("adjusted", 6).alias("adjusted"), (F.col("adjusted") <= alpha).alias("reject"))


# ---- ratios, slopes, cluster intervals ----


def _ratio_sums(a: str, q: str) -> dict[str, Column]:
    x, y = F.col(a).cast("long"), F.col(q).cast("long")
    return {"a": x, "q": y, "aa": x * x, "qq": y * y, "aq": x * y}


def _ratio_moments(cells: DataFrame, *by: str) -> DataFrame:
    """theta = A / Q of equal-scenario means, its linearised standard error, and Q, from each scenario's integer sums."""
    spread = lambda u, v, uv: (F.col("n") * F.col(uv) - F.col(u) * F.col(v)) / (F.col("n") * (F.col("n") - 1)) / F.col("n")
    whole = cells.groupBy(*by).agg(F.avg(F.col("a") / F.col("n")).alias("ma"), F.avg(F.col("q") / F.col("n")).alias("mq"), F.sum(spread("a", "a", "aa")).alias("va"), F.sum(spread("q", "q", "qq")).alias("vq"), F.sum(spread("a", "q", "aq")).alias("c"), F.count("*").alias("g"))
    theta = F.when(F.col("mq") > 0, F.col("ma") / F.col("mq"))
    variance = F.greatest(F.col("va") - 2 * theta * F.col("c") + theta * theta * F.col("vq"), F.lit(0.0))
    return whole.select(*by, "mq", theta.alias("theta"), (F.sqrt(variance) / (F.col("g") * F.col("mq"))).alias("se"))


def _ratio_members(df: DataFrame, a: str, q: str, *by: str) -> DataFrame:
    return placed(df.select(*by, "scenario", "realisation", F.col(a).alias("left"), F.col(q).alias("right")), *by)


def ratio_replicates(df: DataFrame, a: str, q: str, n: int, name: str | Column, *by: str) -> DataFrame:
    """(b, by, mq, theta, se) of each replicate of a ratio of two integer-valued panel columns; theta is null where the denominator is not above 0."""
    return _ratio_moments(resampled(_ratio_members(df, a, q, *by), _ratio_sums("left", "right"), n, name, *by), "b", *by)


def bootstrap_t_ratio(df: DataFrame, a: str, q: str, n: int, name: str | Column, level: float = 0.95, by: str | None = None) -> DataFrame:
    """`bootstrap_t` of a ratio: a replicate without a denominator or without variance counts as a pivot of +infinity.

    With `by`, of each of its values that isn't null, all drawn in one job; the name may be made of it.
    """
    keys = [by] if by else []
    at, sums = _ratio_members(df.dropna(subset=keys) if by else df, a, q, *keys), _ratio_sums("left", "right")
    whole = _ratio_moments(_summed(at, sums, *keys), *keys).select(*keys, F.col("theta").alias("estimate"), F.col("se").alias("se_0"), F.col("mq").alias("denominator"))
    pivot = F.when(F.col("theta").isNull() | (F.col("se") == 0), float("inf")).otherwise(F.abs(F.col("theta") - F.col("estimate")) / F.col("se"))
    found = _ratio_moments(resampled(at, sums, n, name, *keys), "b", *keys)
    pivots = found.join(F.broadcast(whole), by) if by else found.crossJoin(F.broadcast(whole))  # one row for each `by`
    out = pivots.groupBy(*keys, "estimate", "se_0", "denominator").agg(F.element_at(F.array_sort(F.collect_list(F.coalesce(pivot, F.lit(float("inf"))))), ceil(round(level * (n + 1), 9))).alias("critical"), F.count_if(F.coalesce(pivot, F.lit(float("inf"))) >= F.abs("estimate") / F.col("se_0")).alias("beyond"))
    reach = F.col("critical") * F.col("se_0")
    return out.select(F.round("estimate", 6).alias("estimate"), F.round("denominator", 6).alias("denominator"), F.round("se_0", 6).alias("se"), F.round("critical", 6).alias("critical"), F.round(F.col("estimate") - reach, 6).alias("low"), F.round(F.col("estimate") + reach, 6).alias("high"), F.round((1 + F.col("beyond")) / (n + 1), 6).alias("p"), *keys)


def percentile_ratio(df: DataFrame, a: str, q: str, n: int, name: str | Column, level: float = 0.95, by: str | None = None) -> DataFrame:
    """Order statistics of the replicates' ratios, by the ranks of `percentile_interval`; null if fewer are finite than the upper rank.

    `by` is as in `bootstrap_t_ratio`.
    """
    keys = [by] if by else []
    low, high = floor((1 - level) / 2 * (n + 1) + 1e-9), ceil((1 + level) / 2 * (n + 1) - 1e-9)
    ordered = F.array_sort(F.collect_list("theta"))  # nulls are not collected
    end = lambda rank: F.round(F.when(F.count("theta") >= high, F.try_element_at(ordered, F.lit(rank))), 6)
    found = ratio_replicates(df.dropna(subset=keys) if by else df, a, q, n, name, *keys)
    return found.groupBy(*keys).agg(end(low).alias("low"), end(high).alias("high"), F.count("theta").alias("finite")).select("low", "high", "finite", *keys)


def cluster_interval(df: DataFrame, values: list[str], n: int, name: str, tail: float) -> DataFrame:
    """(contrast, low, high): interpolated quantiles `tail` and 1 - `tail` of resampled equal-scenario means; all columns share the draws."""
    at = placed(df.select("scenario", "realisation", *values))
    found = replicate_moments(at, values, n, name)
    return found.groupBy("contrast").agg(F.round(F.percentile("theta", tail), 6).alias("low"), F.round(F.percentile("theta", 1 - tail), 6).alias("high"))


def slope_interval(df: DataFrame, y: str, xs: list[str], n: int, name: str, level: float = 0.95) -> DataFrame:
    """(term, low, high, finite): percentile intervals of slopes within scenarios, whole realisations resampled.

    Each realisation is reduced to its sums of products once; a replicate weighs them by how often it drew each. What is
    solved is one small matrix a replicate, in the tasks that hold the replicates. A column that has no variance in a
    replicate has no slope there; an interval needs one in all.
    """
    names = [*xs, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    value = lambda i: F.col(names[i]).cast("double")
    parts = df.groupBy("scenario", "realisation").agg(F.count("*").alias("rows"), *(F.sum(value(i)).alias(f"s{i}") for i in range(len(names))), *(F.sum(value(i) * value(j)).alias(f"p{i}_{j}") for i, j in pairs))
    sums = ("rows", *(f"s{i}" for i in range(len(names))), *(f"p{i}_{j}" for i, j in pairs))
    cells = resampled(placed(parts), {c: F.col(c) for c in sums}, n, name)
    centred = cells.groupBy("b").agg(*(F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("rows")).alias(f"c{i}_{j}") for i, j in pairs))
    k = len(xs)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {(i, j): batch.column(f"c{i}_{j}").to_numpy(zero_copy_only=False) for i, j in pairs}
            full = np.empty((batch.num_rows, k + 1, k + 1))
            for (i, j), v in c.items():
                full[:, i, j] = full[:, j, i] = v
            slopes = np.full((batch.num_rows, k), np.nan)
            for row, m in enumerate(full):
                active = np.flatnonzero(np.diag(m)[:k] > 1e-12)
                if len(active):
                    slopes[row, active] = np.linalg.lstsq(m[np.ix_(active, active)], m[active, k], rcond=None)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k, dtype=np.int32), len(slopes))), pa.array(slopes.ravel(), from_pandas=True)], ["term", "slope"])

    found = centred.mapInArrow(solve, "term int, slope double")
    low, high = floor((1 - level) / 2 * (n + 1) + 1e-9), ceil((1 + level) / 2 * (n + 1) - 1e-9)
    ordered = F.array_sort(F.collect_list("slope"))
    end = lambda rank: F.round(F.when(F.count("slope") == n, F.try_element_at(ordered, F.lit(rank))), 6)
    return found.groupBy("term").agg(end(low).alias("low"), end(high).alias("high"), F.count("slope").alias("finite")).withColumn("term", F.element_at(F.array(*map(F.lit, xs)), F.col("term") + 1))
