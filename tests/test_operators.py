"""Operators against small cases worked by hand or by plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import addressing, classify
from tidemark.functions import scenarios as sc
from tidemark.operators import checks, frontier, lineage, ordered, panel, regression, resample, selection, trees


def test_uniform_is_the_digest(spark):
    address = '["DT-P9-DRAW-v1","k","R",3,1]'
    want = (int(hashlib.sha256(address.encode()).hexdigest()[:16], 16) >> 11) + 0.5
    got = spark.range(1).select(addressing.uniform_at(F.lit("k"), F.lit("R"), F.lit(3), F.lit(1)).alias("u")).first().u
    assert got == want / 2**53


def test_fourteen_scenarios_start_with_stationary():
    names = sc.scenarios()
    assert len(names) == 14 and names[0] == "LOCAL_TREE-STATIONARY-NONE" and names[7] == "OBLIQUE-STATIONARY-NONE"


def test_practical_class_includes_its_bounds(spark):
    rows = spark.createDataFrame([(-1.0, 1.0), (1.1, 2.0), (-3.0, -1.1), (0.0, 2.0)], "low double, high double")
    got = [r[0] for r in rows.select(classify.practical_class(F.col("low"), F.col("high"), 1.0)).collect()]
    assert got == ["EQUIVALENT", "BENEFICIAL", "HARMFUL", "INCONCLUSIVE"]


def test_equal_scenario_mean_ignores_cell_sizes(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 3.0), ("b", 1, 5.0)], "scenario string, realisation int, x double")
    assert panel.equal_scenario_mean(df, "x").first()["mean"] == 3.0


def test_ties_share_the_credit(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, 1.0), ("a", 1, 2, 2.0)], "scenario string, realisation int, arm int, x double")
    assert {r.arm: r.rate for r in panel.minimum_rates(df, "x").collect()} == {0: 0.5, 1: 0.5, 2: 0.0}


def test_pareto_and_supported(spark):
    points = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 4.5), ("c", 3.0, 1.0), ("d", 3.0, 2.0)], "k string, cost double, loss double")
    assert {r.k for r in frontier.pareto(points, "k", ["cost", "loss"]).collect()} == {"a", "b", "c"}
    assert {r.k for r in frontier.supported(points, "k", "cost", "loss").collect()} == {"a", "c"}


def test_segments_part_rows_as_floors_do(spark):
    for n in (1, 5, 8, 11):
        got = [r[0] for r in spark.range(n).orderBy("id").select(ordered.segment(F.col("id"), F.lit(n), 4)).collect()]
        want = [next(k for k in range(4) if k * n // 4 <= i < (k + 1) * n // 4) for i in range(n)]
        assert got == want


def test_confusion_is_null_without_a_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "y int, p int")
    got = ordered.confusion(df, "y", "p").first()
    assert (got.tp, got.fn, got.recall_1, got.recall_0, got.balanced_accuracy) == (1, 1, 0.5, None, None)


def test_best_split_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)).round(1), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y int")
    gini = lambda t: 2 * t.sum() * (len(t) - t.sum()) / len(t)
    best = None
    for j in range(3):
        values = sorted(set(x[:, j]))
        for a, b in zip(values, values[1:], strict=False):
            left = x[:, j] <= a
            if left.sum() >= 3 and (~left).sum() >= 3:
                key = (round((gini(y[left]) + gini(y[~left])) / 60, 9), j, a / 2 + b / 2)
                best = min(best or key, key)
    got = trees.best_split(trees.value_counts(trees.long_features(df, "id", "v", F.col("y"))), min_leaf=3).first()
    assert (got.impurity, got.feature, got.threshold) == best
    grown = trees.grow(df, "id", "v", F.col("y"), depth=2, min_leaf=3).collect()
    assert {r.node for r in grown} >= {1} and next(r for r in grown if r.node == 1).threshold == got.threshold


def test_holm_runs_upwards(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03)], "name string, p double")
    got = {r["name"]: (r.adjusted, r.reject) for r in resample.holm(tests, "name", "p").collect()}
    assert got == {"a": (0.03, True), "b": (0.04, True), "c": (0.04, True)}


def test_lineage(spark):
    records = spark.createDataFrame([(1, []), (2, [1]), (3, [1, 2]), (4, [3, 9]), (5, [5])], "id long, parents array<long>")
    edge = lineage.edges(records.where("id <= 3"))
    assert {(r.node, r.ancestor) for r in lineage.ancestors(edge).collect()} == {(2, 1), (3, 1), (3, 2)}
    roots = records.where("size(parents) = 0").select(F.col("id").alias("node"))
    assert {r.node: r.depth for r in lineage.depths(edge, roots).collect()} == {1: 0, 2: 1, 3: 2}
    assert {(r.node, r.rule) for r in lineage.violations(records).collect()} == {(4, "order"), (4, "missing"), (5, "order")}


def test_lineage_has_no_limit_of_rows_or_generations(spark):
    limits = {"spark.sql.cteRecursionLevelLimit": "5", "spark.sql.cteRecursionRowLimit": "200"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        n = 20  # two parents each: the number of paths doubles every second generation
        edge = spark.createDataFrame([(c, p) for c in range(2, n + 1) for p in (c - 1, c - 2) if p >= 1], "child long, parent long")
        assert sorted((r.node, r.ancestor) for r in lineage.ancestors(edge).collect()) == [(c, p) for c in range(1, n + 1) for p in range(1, c)]
        roots = spark.createDataFrame([(1,)], "node long")
        assert {r.node: r.depth for r in lineage.depths(edge, roots).collect()} == {c: c - 1 for c in range(1, n + 1)}
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_digests(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "o int, l string")
    assert checks.order_digest(df, "o", F.col("l")).first().digest == hashlib.sha256(b"a\nb\n").hexdigest()
    twice = df.union(df)
    assert checks.multiset_digest(twice, F.col("l")).first().digest == hashlib.sha256(b"a\t2\nb\t2\n").hexdigest()


def test_numeric_differences_and_override(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 1.0)], "k int, v double")
    assert {r.k for r in checks.numeric_differences(a, b, ["k"], "v").collect()} == {2, 3}
    merged = checks.override(a, b, key="k", retired=spark.createDataFrame([(1,)], "k int"))
    assert {(r.k, r.v) for r in merged.collect()} == {(2, 2.5), (3, 1.0)}


def test_fixed_effects_recover_slopes(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(z), float(3 * x - 2 * z + 10 * g)) for g in (0, 1) for x, z in rng.integers(0, 9, (20, 2))]
    got = {r.term: r.slope for r in regression.fixed_effects(spark.createDataFrame(rows, "g int, x double, z double, y double"), "y", ["x", "z"], "g").collect()}
    assert got == {"x": 3.0, "z": -2.0}


# ---- streams, by hand ----


def test_stream_keys_and_concepts(spark):
    key = spark.range(1).select(sc.stream_key(F.lit("LOCAL_TREE-STATIONARY-NONE"), F.lit(0))).first()[0]
    assert key == "9463861a45169367"
    cases = [
        ("ABRUPT-MILD", 10_000, 0.0, 0), ("ABRUPT-MILD", 10_001, 0.0, 1), ("ABRUPT-MILD", 20_001, 0.0, 2), ("RECURRENT-SEVERE", 15_000, 0.0, 1), ("RECURRENT-SEVERE", 20_001, 0.0, 0),
        ("STATIONARY-NONE", 26_000, 0.0, 0), ("GRADUAL-MILD", 10_001, 0.0, 1), ("GRADUAL-MILD", 10_001, 0.5, 0), ("GRADUAL-MILD", 12_000, 0.999, 1), ("GRADUAL-MILD", 15_000, 0.0, 1), ("GRADUAL-MILD", 15_000, 0.99, 1),
        ("GRADUAL-MILD", 20_000, 0.99, 1), ("GRADUAL-MILD", 21_000, 0.4, 2), ("GRADUAL-MILD", 21_000, 0.6, 1), ("GRADUAL-MILD", 25_000, 0.0, 2), ("GRADUAL-MILD", 9_000, 0.0, 0),
    ]
    rows = spark.createDataFrame([(f"{f}-{s}", t, m, c) for f in sc.FAMILIES for s, t, m, c in cases], "scenario string, t int, mixture double, want int")
    assert rows.where(sc.concept_at(F.col("scenario"), F.col("t"), F.col("mixture")) != F.col("want")).count() == 0


def test_clean_labels(spark):
    a, b = [0.2, 0.05, 0.2] + [0.0] * 5, [0.8, 0.2, 0.05] + [0.0] * 5
    u, v = [1.0] * 4 + [0.0] * 4, [-1.0] * 4 + [3.0] * 4
    cases = [
        (a, "LOCAL_TREE-ABRUPT-MILD", 0, 1), (a, "LOCAL_TREE-ABRUPT-MILD", 1, 0), (b, "LOCAL_TREE-ABRUPT-MILD", 1, 1), (b, "LOCAL_TREE-ABRUPT-MILD", 2, 0), (u, "OBLIQUE-ABRUPT-SEVERE", 0, 1), (u, "OBLIQUE-ABRUPT-SEVERE", 2, 1),
        ([-x for x in u], "OBLIQUE-ABRUPT-SEVERE", 1, 0), (v, "OBLIQUE-ABRUPT-SEVERE", 0, 0), (v, "OBLIQUE-ABRUPT-SEVERE", 1, 1), (v, "OBLIQUE-STATIONARY-NONE", 0, 0),
    ]
    rows = spark.createDataFrame(cases, "x array<double>, scenario string, concept int, want int")
    got = rows.select("want", sc.clean_label(F.col("scenario"), [F.col("x")[j] for j in range(8)], F.col("concept")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_thresholds_of_constants_extremes_and_many_values(spark):
    values = [(0, 1.0), (1, 1e308), (1, 1.1e308), *((2, float(x)) for x in range(101)), (3, 1.0), (3, float(np.nextafter(1.0, 2.0)))]
    got = {}
    for r in trees.candidate_thresholds(spark.createDataFrame(values, "feature int, value double"), 4).orderBy("slot").collect():
        got.setdefault(r.feature, []).append(r.cut)
    assert got[0] == [1.0] and got[1] == [1e308 / 2 + 1.1e308 / 2] and got[3] == [float(np.nextafter(1.0, 2.0))]
    assert got[2] == [k * 100 // 5 + 0.5 for k in (1, 2, 3, 4)]


# ---- fronts ----


def test_fronts_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    for high in (6, 1000):
        points = [(i, int(c), int(v)) for i, (c, v) in enumerate(rng.integers(0, high, (150, 2)))]
        df = spark.createDataFrame(points, "k int, cost long, loss long")
        want = {i for i, c, v in points if not any(a <= c and b <= v and (a < c or b < v) for _, a, b in points)}
        assert {r.k for r in frontier.pareto(df, "k", ["cost", "loss"]).collect()} == want
        prices = [0.0, *((v - b) / (a - c) for _, c, v in points for _, a, b in points if a > c and v > b)]
        best = set()
        for p in prices:
            least = min(v + p * c for _, c, v in points)
            best |= {(i, c, v) for i, c, v in points if v + p * c <= least + 1e-9}
        cheapest = min(c for _, c, _ in points)
        best |= {x for x in points if x[1] == cheapest and x[2] == min(v for _, c, v in points if c == cheapest)}
        assert {r.k for r in frontier.supported(df, "k", "cost", "loss").collect()} == {i for i, *_ in best}
        more = df.withColumn("third", F.col("k") % 7)
        got = {r.k for r in frontier.pareto(more, "k", ["cost", "loss", "third"]).collect()}
        assert got == {i for i, c, v in points if not any(a <= c and b <= v and j % 7 <= i % 7 and (a < c or b < v or j % 7 < i % 7) for j, a, b in points)}


def test_break_even_and_dominance(spark):
    df = spark.createDataFrame([(0.5, 0.1, 2.0, 1.0), (0.5, -0.1, 2.0, 1.0)], "s double, sl double, p double, pl double")
    got = df.select(*frontier.break_even({"estimate": F.col("s"), "low": F.col("sl")}, {"estimate": F.col("p"), "low": F.col("pl")}, 1000)).collect()
    assert tuple(got[0]) == ("STABLE", 0.04, 0.004, 0.25) and tuple(got[1]) == ("UNSTABLE_ACCURACY_INCREMENT", None, None, None)
    sides = spark.createDataFrame([("LEFT_LOWER", "LEFT_LOWER"), ("RIGHT_LOWER", "RIGHT_LOWER"), ("LEFT_LOWER", "UNRESOLVED")], "x string, y string")
    assert [r[0] for r in sides.select(classify.dominance([F.col("x"), F.col("y")], F.lit("l"), F.lit("r"))).collect()] == ["l", "r", None]


# ---- resampling ----


def _cells(seed, n=9):
    rng = np.random.default_rng(seed)
    return [(g, r, int(a), int(q)) for g in "xy" for r, (a, q) in enumerate(rng.integers(1, 30, (n, 2)))]


def _tape(cells, b, name):
    """The draws of one replicate, from the addresses."""
    out = []
    for g in "xy":
        own = [c for c in cells if c[0] == g]
        out.append([own[(int(hashlib.sha256(f"{name}|{b}|{g}|{i}".encode()).hexdigest()[:16], 16) >> 11) % len(own)] for i in range(len(own))])
    return out


def test_ratio_bootstrap_by_hand(spark):
    cells = _cells(1)
    df = spark.createDataFrame(cells, "scenario string, realisation int, a long, q long")

    def moments(groups):
        a, q = (np.array([[c[k] for c in g] for g in groups], float) for k in (2, 3))
        theta = a.mean(1).mean() / q.mean(1).mean()
        return theta, np.sqrt(np.var(a - theta * q, axis=1, ddof=1).sum() / (4 * a.shape[1])) / q.mean(1).mean()

    theta, se = moments([[c for c in cells if c[0] == g] for g in "xy"])
    reps = [moments(_tape(cells, b, "R")) for b in range(99)]
    pivots = sorted(abs(t - theta) / s for t, s in reps)
    row = resample.bootstrap_t_ratio(df, "a", "q", 99, "R").first()
    assert np.allclose([row.estimate, row.se, row.critical], [theta, se, pivots[94]], atol=2e-6)
    assert row.p == round((1 + sum(t >= theta / se for t in pivots)) / 100, 6)
    ends = resample.percentile_ratio(df, "a", "q", 99, "R").first()
    ordered = sorted(t for t, _ in reps)
    assert np.allclose([ends.low, ends.high], [ordered[1], ordered[97]], atol=2e-6) and ends.finite == 99
    got = resample.cluster_interval(df, ["a"], 99, "R", 0.05).first()
    means = [np.mean([np.mean([c[2] for c in g]) for g in _tape(cells, b, "R")]) for b in range(99)]
    assert np.allclose([got.low, got.high], np.quantile(means, [0.05, 0.95]), atol=2e-6)
    zero = df.withColumn("q", F.lit(0).cast("long"))
    assert resample.percentile_ratio(zero, "a", "q", 99, "R").first().low is None


def test_draws_of_members_in_several_blocks_and_groups(spark, monkeypatch):
    """Members of a scenario are dealt by places and its replicates by groups; nothing goes to the driver but counts."""
    cells = _cells(1)
    at = resample.placed(spark.createDataFrame(cells, "scenario string, realisation int, a long, q long"))
    monkeypatch.setattr(resample, "BLOCK", 3)
    monkeypatch.setattr(resample, "GROUP", 40)
    monkeypatch.setattr(resample, "DRAWS", 4)
    monkeypatch.setattr("pyspark.sql.DataFrame.toArrow", None)
    got = {(r.b, r.scenario): (r.n, r.s) for r in resample.resampled(at, {"s": F.col("a")}, 25, "R").collect()}
    assert got == {(b, g): (len(t), sum(c[2] for c in t)) for b in range(25) for g, t in zip("xy", _tape(cells, b, "R"), strict=True)}


def test_draws_are_made_once_in_a_job_of_their_own(spark):
    """What waits for a broadcast never shares slots with draws: the plans over replicates read stored sums."""
    df = spark.createDataFrame(_cells(1), "scenario string, realisation int, a long, q long")
    plans = [
        resample.bootstrap_t_ratio(df, "a", "q", 99, "R"), resample.percentile_ratio(df, "a", "q", 99, "R"), resample.bootstrap_t(df, "a", 99, "R"), resample.percentile_interval(df, "a", 99, "R"),
        resample.max_t(df, ["a", "q"], 99, "R"), resample.cluster_interval(df, ["a"], 99, "R", 0.05), resample.slope_interval(df, "a", ["q"], 99, "R"),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in text and "Scan ExistingRDD" not in text


def test_ratios_of_several_arms_are_drawn_in_one_job(spark, monkeypatch):
    """Each arm has draws of its own and the result it has alone; rows without an arm take no part."""
    cells = [(arm, *c) for arm in range(3) for c in _cells(arm)] + [(None, "x", 0, 1, 1)]
    df = spark.createDataFrame(cells, "arm long, scenario string, realisation int, a long, q long")
    alone = {arm: df.where(F.col("arm") == arm).drop("arm") for arm in range(3)}
    stored, store = [], resample.store
    monkeypatch.setattr(resample, "store", lambda d: stored.append(d) or store(d))
    name = F.concat(F.lit("R"), F.col("arm").cast("string"))
    for found in (resample.bootstrap_t_ratio, resample.percentile_ratio):
        stored.clear()
        together = found(df, "a", "q", 49, name, by="arm")
        assert len(stored) == 3 and together.columns[-1] == "arm"
        got = {r.arm: r for r in together.collect()}
        assert {arm: tuple(r)[:-1] for arm, r in got.items()} == {arm: tuple(found(d, "a", "q", 49, f"R{arm}").first()) for arm, d in alone.items()}


def test_groups_of_draws_are_dealt_one_to_a_task(spark, monkeypatch):
    df = spark.createDataFrame(_cells(1, 40), "scenario string, realisation int, a long, q long")
    at, plans, store = resample.placed(df), [], resample.store
    monkeypatch.setattr(resample, "GROUP", 100)
    monkeypatch.setattr(resample, "store", lambda d: plans.append(d._jdf.queryExecution().toString()) or store(d))
    got = {(r.b, r.scenario): (r.n, r.s) for r in resample.resampled(at, {"s": F.col("a")}, 25, "R").collect()}
    assert got == {(b, g): (len(t), sum(c[2] for c in t)) for b in range(25) for g, t in zip("xy", _tape(_cells(1, 40), b, "R"), strict=True)}
    after = plans[-1][plans[-1].index("Physical Plan") :]
    assert after.index("FlatMapGroupsInArrow") < after.index("direct_shuffle_partition_id") and "hashpartitioning(task" not in after


@pytest.mark.parametrize("held", [1, 16 * 7, 16 * 40, 1 << 22])
def test_draws_are_counted_by_member_or_looked_up(spark, monkeypatch, held):
    cells = _cells(1, 40)
    at = resample.placed(spark.createDataFrame(cells, "scenario string, realisation int, a long, q long"))
    monkeypatch.setattr(resample, "HELD", held)
    monkeypatch.setattr(resample, "DRAWS", 4)
    sums = {"s": F.col("a"), "d": F.col("q").cast("double")}
    got = {(r.b, r.scenario): (r.n, r.s, r.d) for r in resample.resampled(at, sums, 5, "R").collect()}
    assert got == {(b, g): (len(t), sum(c[2] for c in t), float(sum(c[3] for c in t))) for b in range(5) for g, t in zip("xy", _tape(cells, b, "R"), strict=True)}


def test_members_are_copied_many_to_a_row(spark, monkeypatch):
    cells = _cells(1, 40)
    at = resample.placed(spark.createDataFrame(cells, "scenario string, realisation int, a long, q long"))
    rows, frames, deal = [], type(at), type(at).repartitionById
    monkeypatch.setattr(frames, "repartitionById", lambda d, *a: rows.append(d.count()) or deal(d, *a))
    monkeypatch.setattr(resample, "GROUP", 100)
    for pack, block, copies in ((1 << 10, 1 << 21, 1), (16, 1 << 21, 3), (4, 10, 12)):
        monkeypatch.setattr(resample, "PACK", pack)
        monkeypatch.setattr(resample, "BLOCK", block)
        got = {(r.b, r.scenario): (r.n, r.s) for r in resample.resampled(at, {"s": F.col("a")}, 20, "R").collect()}
        assert got == {(b, g): (len(t), sum(c[2] for c in t)) for b in range(20) for g, t in zip("xy", _tape(cells, b, "R"), strict=True)}
        assert rows.pop() == copies * 2 * 7


def test_columns_are_read_in_order_and_undrawn_gaps_stay_out():
    place = np.array([0, 2, 2, 0, 3])
    assert resample._fallen([np.array([1, 10, 100, 1000]), np.array([1.0, np.nan, 2.0, 3.0])], place) == [1202, 9.0]
    assert np.isnan(resample._fallen([np.array([np.nan, 0, 0, 0])], place)[0]) and resample._fallen([np.arange(3)], place[:0]) == [0]

    class Read(np.ndarray):
        def __getitem__(self, at):
            raise AssertionError("looked up draw by draw")

    assert resample._fallen([np.array([1, 10, 100, 1000]).view(Read)], place) == [1202]


def test_key_differences_take_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(checks, "TASK_ROWS", 10, raising=False)
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "y"), (4, "y")], "k long, s string")
    got = checks.key_differences(a, b, ["k", "s"])
    want = [(2, None, "missing"), (2, None, "unexpected"), (3, "y", "missing"), (4, "y", "unexpected")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    many = spark.range(300).select(F.col("id").alias("k"))
    assert checks.key_differences(many, many, ["k"]).rdd.getNumPartitions() == 60


def test_ancestors_look_back_seldom_and_end_on_cycles(spark):
    plans = lineage.store
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (5, 1)], "child long, parent long")
    joins = []
    lineage.store = lambda df: (joins.append("LeftAnti" in df._jdf.queryExecution().optimizedPlan().toString()), plans(df))[1]
    try:
        got = sorted(map(tuple, lineage.ancestors(edge).collect()))
    finally:
        lineage.store = plans
    cycle = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
    assert got == sorted([*cycle, *((4, b) for b in (1, 2, 3)), *((5, b) for b in (1, 2, 3, 4))])
    assert 0 < sum(joins) <= len(joins) // 4


def test_sweeps_by_ranges_give_the_same_split(spark, monkeypatch):
    """More values than a task takes are dealt by ranges of their order, not one feature to a task."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b)], int(a + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)).round(2))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    counts = trees.value_counts(trees.long_features(df, "id", "v", F.col("y")))
    whole = trees.best_split(counts, min_leaf=3).first()
    sweep = sorted(map(tuple, trees._swept(counts).collect()))
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    assert trees.best_split(counts, min_leaf=3).first() == whole
    names = ["feature", "value", "nl", "ol", "nt", "ot", "after"]
    ranged = trees._swept(counts)
    got = {tuple(r[c] for c in names) for r in ranged.collect()}
    monkeypatch.undo()
    assert got == {tuple(r[c] for c in names) for r in trees._swept(counts).collect()} and len(got) == len(sweep)


def test_trees_count_values_in_tasks_by_rows(spark, monkeypatch):
    """A task explodes and counts some TASK_ROWS components, however few files or partitions hold the rows; a frequent value is added up."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(a), float(i % 2), float(b)], int(a > 0.3)) for i, (a, b) in enumerate(rng.normal(size=(90, 2)).round(2))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").coalesce(1)
    whole = sorted(map(tuple, trees.grow(df, "id", "v", F.col("y"), 2, 3).collect()))
    long = trees.long_features(df, "id", "v", F.col("y"))
    cuts = sorted(map(tuple, trees.candidate_thresholds(long, 5).collect()))
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    even, tasks = trees.dealt(df, "v")
    assert tasks == even.rdd.getNumPartitions() == 27 and max(even.rdd.glom().map(len).collect()) <= 5
    counts = trees.value_counts(trees.long_features(even, "id", "v", F.col("y")), tasks=tasks)
    assert counts.rdd.getNumPartitions() == 27 and counts.where("feature = 1").count() > 2
    assert sorted(map(tuple, trees.grow(df, "id", "v", F.col("y"), 2, 3).collect())) == whole
    assert sorted(map(tuple, trees.candidate_thresholds(long, 5).collect())) == cuts and len(cuts) == 11


def test_slope_interval_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [(g, r, float(x), 0.0, float(2 * x + rng.normal() + 5 * (g == "x"))) for g in "xy" for r in range(8) for x in rng.integers(0, 9, 3)]
    df = spark.createDataFrame(rows, "scenario string, realisation int, x double, flat double, y double")
    slopes = []
    for b in range(99):
        sxx = sxy = 0.0
        for g in _tape([(s, i, 0, 0) for s in "xy" for i in range(8)], b, "S"):
            own = np.array([[x, y] for s, r, *_ in g for t, q, x, _, y in rows if (t, q) == (s, r)])
            x, y = (own - own.mean(0)).T
            sxx, sxy = sxx + x @ x, sxy + x @ y
        slopes.append(sxy / sxx)
    slopes.sort()
    got = {r.term: r for r in resample.slope_interval(df, "y", ["x", "flat"], 99, "S").collect()}
    assert np.allclose([got["x"].low, got["x"].high], [slopes[1], slopes[97]], atol=2e-6)
    assert (got["flat"].low, got["flat"].finite) == (None, 0)


def test_welch_freedom(spark):
    cells = _cells(4)
    df = spark.createDataFrame([(g, r, a, 3) for g, r, a, _ in cells], "scenario string, realisation int, a long, same int")
    groups = np.array([[c[2] for c in cells if c[0] == g] for g in "xy"], float)
    part = groups.var(axis=1, ddof=1) / groups.shape[1]
    got = {r.contrast: r for r in panel.effective_freedom(df.withColumn("same", F.col("same").cast("long")), "a", "same").collect()}
    assert np.allclose([got["a"].variance, got["a"].freedom], [part.sum() / 4, part.sum() ** 2 / ((part**2) / 8).sum()], atol=2e-6)
    assert got["same"].variance == 0 and got["same"].freedom is None


# ---- checks, order, selection ----


def test_encoder_learns_from_a_prefix_only(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 4.0, None), (4, 9.0, "z"), (5, None, "b")], "i int, x double, c string")
    fitted = checks.fit_encoder(df.where("i <= 3"), ["x"], ["c"])
    got = [(r.x, r.x_missing, r.c) for r in checks.encode_with(df, fitted, ["x"], ["c"]).orderBy("i").collect()]
    assert got == [(1.0, 0, 1), (2.5, 1, 0), (4.0, 0, -2), (9.0, 0, -1), (2.5, 1, 1)]


def test_gaps_chains_and_ranks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 4, "x"), ("b", 2, "x")], "k string, o int, e string")
    assert {tuple(r) for r in ordered.gaps(df, "k", "o").collect()} == {("a", 4, 3), ("b", 2, 1)}
    chain = ""
    for e in "xyx":
        chain = hashlib.sha256((chain + e).encode()).hexdigest()
    assert {r.k: (r.events, r.chain) for r in ordered.hash_chain(df, "k", "o", F.col("e")).collect()}["a"] == (3, chain)
    assert {(r.k, r.o, r.nth) for r in ordered.duplicate_rank(df, ["e"], "k", "o").collect()} == {("a", 1, 1), ("a", 4, 2), ("b", 2, 3), ("a", 2, 1)}
    assert tuple(ordered.ends(df, "k", "o", "e").where("k = 'a'").first()) == ("a", "x", "x")


def test_range_digest_is_of_digests(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in (0, 1, 2, 5, 7)], "o long, l string")
    sha = lambda lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()
    want = sha([sha([sha(["l0", "l1"]), sha(["l2"])]), sha([sha(["l5"]), sha(["l7"])])])
    assert tuple(checks.range_digest(df, "o", F.col("l"), 2).first()) == (want, 4)


def test_selections(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.9), ("g", 3, 0.9), ("h", 1, 0.1)], "g string, o int, f double")
    assert {(r.g, r.o, r["rank"]) for r in selection.survivors(df, "g", "f", "o", 2).collect()} == {("g", 2, 1), ("g", 3, 2), ("h", 1, 1)}
    key = "0123456789abcdef"
    for r in selection.tournament(df, "g", "f", "o", 9, 3, key, "T").where("g = 'g'").collect():
        drawn = []
        for i in range(3):
            j = int(hashlib.sha256(f'["DT-P9-DRAW-v1","{key}","T:g",{r.round},{i}]'.encode()).hexdigest()[:16], 16) >> 11
            drawn.append(int((j + 0.5) / 2**53 * 3) + 1)
        best = max({1: 0.5, 2: 0.9, 3: 0.9}[o] for o in drawn)
        assert r.winner == next(o for o in drawn if {1: 0.5, 2: 0.9, 3: 0.9}[o] == best)
    sites = spark.createDataFrame([("t", ""), ("u", "0"), ("u", "01"), ("u", "010"), ("u", "11"), ("t", "1")], "k string, p string")
    assert {tuple(r) for r in selection.maximal_sites(sites, "k", "p").collect()} == {("t", ""), ("u", "0"), ("u", "11")}


def test_contracts_groups_and_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, "c")], "k int, m string")
    assert {tuple(r) for r in checks.incomplete_groups(df, ["k"], "m", ["a", "b"]).collect()} == {(2, 1, 1), (3, 1, 1)}
    assert {tuple(r) for r in checks.violations(df, ["k"], {"known": F.col("m").isin("a", "b"), "null": F.lit(None).cast("boolean") | (F.col("k") < 3)}).collect()} == {(3, "known"), (3, "null")}
    assert checks.expected_keys(df.select("k").distinct(), ["x", "y"], "m").count() == 6
    got = checks.retention(df.where("k = 1").withColumn("g", F.lit(0)), df.where("k = 3").withColumn("g", F.lit(0)), ["g"], "m").first()
    assert (got.kept, got.of, got.retained) == (1, 2, 0.5)
    near = spark.createDataFrame([(1.0, 1.0 + 1e-13), (1.0, 1.1), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in near.select(checks.tolerance(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_trees_by_nodes(spark):
    splits = spark.createDataFrame([(1, 0, 0.5), (3, 2, -1.25)], "node long, feature int, threshold double")
    row = trees.summary(splits).first()
    assert (row.splits, row.nodes, row.depth) == (2, 5, 2) and row.fingerprint == hashlib.sha256(b"1|0|500000000\n3|2|-1250000000").hexdigest()


def test_large_means_cost_no_digits(spark):
    rng = np.random.default_rng(5)
    rows = [(g, 1e9 + float(x), 1e9 + 3 * float(x)) for g in (0, 1) for x in rng.normal(size=50)]
    got = regression.fixed_effects(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g").first()
    assert abs(got.slope - 3) < 1e-5
