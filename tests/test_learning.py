"""Trees along a stream and populations over rows, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forests, rolling


def walk(tree, x):
    node = 1
    while tree[node][0] is not None:
        feature, threshold, _ = tree[node]
        value = x[feature] if x is not None and feature < len(x) else None
        node = 2 * node + (0 if value is not None and value < threshold else 1)
    return node


def below(node, site):
    """Whether a node is the site or under it."""
    return node >= site and node >> (node.bit_length() - site.bit_length()) == site


def grown_by_force(x, y, depth, min_leaf, node=1):
    """The tree by trying every cut of every feature."""
    ones, n = sum(y), len(y)
    best = None
    if 0 < ones < n and node.bit_length() <= depth:
        for f in range(len(x[0])):
            values = sorted({r[f] for r in x})
            for a, b in zip(values, values[1:]):
                left = [c for r, c in zip(x, y, strict=True) if r[f] <= a]
                right = [c for r, c in zip(x, y, strict=True) if r[f] > a]
                if min(len(left), len(right)) >= min_leaf:
                    gini = round(sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in (left, right)) / n, 9)
                    if best is None or gini < best[0]:
                        best = gini, f, a / 2 + b / 2 if a < a / 2 + b / 2 <= b else b
    action = int(2 * ones > n)
    if best is None:
        return {node: (None, None, action)}
    out = {node: (best[1], best[2], action)}
    for side in (0, 1):
        rows = [k for k, r in enumerate(x) if (r[best[1]] < best[2]) == (side == 0)]
        out |= grown_by_force([x[k] for k in rows], [y[k] for k in rows], depth, min_leaf, 2 * node + side)
    return out


@pytest.mark.parametrize(("depth", "min_leaf"), [(99, 1), (3, 2), (1, 4), (0, 1)])
def test_fitting_is_trying_every_cut(depth, min_leaf):
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 6, (n, 3)).astype(float), rng.integers(0, 2, n)
        got = {node: (f, t, a) for node, f, t, a in rolling.fit_tree(x, y, depth, min_leaf)}
        assert got == grown_by_force(x.tolist(), y.tolist(), depth, min_leaf)


@pytest.mark.parametrize("depth, min_leaf", [(None, 1), (2, 2), (3, 4), (0, 1)])
def test_trees_side_by_side_are_those_fitted_alone(depth, min_leaf):
    rng = np.random.default_rng(5)
    x, y, held = rng.integers(-3, 4, (300, 20, 3)) / 2.0, rng.integers(0, 2, (300, 20)), rng.random((300, 20)) < rng.random((300, 1))
    held[0] = False
    x[1], x[2, :, 1], y[3] = 1.0, 0.0, 1
    got = [{} for _ in x]
    for level in rolling.fit_trees(x, y, held, depth, min_leaf):
        for tree, node, feature, threshold, action in zip(*(c.tolist() for c in level), strict=True):
            assert node not in got[tree]
            got[tree][node] = (None, None, action) if feature < 0 else (feature, threshold, action)
    for one, v, c, h in zip(got, x, y, held, strict=True):
        assert one == {node: tuple(rest) for node, *rest in rolling.fit_tree(v[h], c[h], depth, min_leaf)}


def test_relational_growth_of_many_trees_is_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(int(t), [float(v) for v in rng.integers(0, 9, 3)], int(rng.integers(0, 2))) for t in range(5) for _ in range(int(rng.integers(1, 60)))]
    got = forests.grow_nodes(spark.createDataFrame(rows, "t int, x array<double>, y int"), ["t"], "x", "y", 3, 2).collect()
    for t in range(5):
        x, y = [r[1] for r in rows if r[0] == t], [r[2] for r in rows if r[0] == t]
        assert {r.node: (r.feature, r.threshold, r.action) for r in got if r.t == t} == grown_by_force(x, y, 3, 2)


def stream(seed):
    """Keys of 1 to 400 rows, some with missing features or labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in ((None, 30), ("hot", 400), ("short", 5), ("exact", 10), ("one", 1)):
        for seq in range(n):
            x = [float(v) for v in rng.integers(0, 5, 2)]
            y = int(x[0] + rng.normal() > 2.5) if seq < n / 2 else int(x[1] + rng.normal() > 2.5)
            rows.append((key, seq, [x[0], None] if rng.random() < 0.05 else None if rng.random() < 0.02 else x, None if rng.random() < 0.03 else y))
    return rows


def along_the_stream(rows, warmup, window, every, depth, min_leaf):
    """One row after another: predict, reveal, refit."""
    out = {}
    for key in {r[0] for r in rows}:
        seen, tree, refit, fitted = [], None, 0, 0
        for _, seq, x, y in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if tree:
                out[key, seq] = (refit, fitted, tree[walk(tree, x)][2])
            seen.append((x, y))
            due = len(seen) == warmup or every and len(seen) > warmup and (len(seen) - warmup) % every == 0
            if due:
                held = [(a, b) for a, b in (seen if len(seen) == warmup else seen[-window:]) if a is not None and None not in a and b is not None]
                refit, fitted = (len(seen) - warmup) // every if every else 0, len(seen)
                tree = grown_by_force([a for a, _ in held], [b for _, b in held], depth, min_leaf) if held else {1: (None, None, 0)}
    return out


@pytest.mark.parametrize(("warmup", "window", "every", "depth", "min_leaf"), [(10, 20, 5, 99, 1), (10, 7, 10, 2, 2), (3, 40, 1, 2, 1), (10, None, None, 99, 1), (10, 25, 4, 3, 3)])
def test_each_row_is_predicted_before_it_is_learned(spark, warmup, window, every, depth, min_leaf):
    rows = stream(warmup)
    df = spark.createDataFrame(rows, "key string, seq long, x array<double>, y int").repartition(5)
    got = rolling.prequential(df, "key", "seq", "x", "y", warmup, window, every, depth, min_leaf).collect()
    assert {(r.key, r.seq): (r.refit, r.fitted_at, r.pred) for r in got} == along_the_stream(rows, warmup, window, every, depth, min_leaf)
    assert len(got) == len({(r.key, r.seq) for r in got})
    losses = rolling.loss_summary(spark.createDataFrame([(r.key, r.seq, r.refit, r.pred, r.y) for r in got], "key string, seq long, refit long, pred int, y int"), "key", "y").collect()
    for r in losses:
        own = [g for g in got if g.key == r.key]
        assert (r.prediction_calls, r.loss_sum) == (len(own), sum(g.y is None or g.pred != g.y for g in own))


def test_chunks_stay_small(spark):
    """A key's rows are dealt to chunks of at most two windows and a step, and each row to few of them."""
    df = spark.createDataFrame([("hot", i, [float(i % 7)], i % 2) for i in range(5000)], "key string, seq long, x array<double>, y int")
    trees = rolling.refits(df, "key", "seq", "x", "y", 50, 200, 10, 2)
    assert trees.select("refit").distinct().count() == 1 + (5000 - 50) // 10
    assert trees.where("node = 1").count() == 1 + (5000 - 50) // 10


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, seq long, x array<double>, y int")
    assert rolling.prequential(df, "key", "seq", "x", "y", 5, 10, 5).count() == 0


# ---- populations ----


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=3)] if i % 17 else ([float(i % 3)] if i % 2 else None), int(rng.integers(0, 2)) if i % 29 else None) for i in range(500)]
    nodes = []
    for t in range(6):
        own = [(x, y) for i, x, y in rows if i % 6 == t and x is not None and len(x) == 3 and y is not None]
        nodes += [(f"t{t}", n, f, c, a) for n, (f, c, a) in grown_by_force([x for x, _ in own], [y for _, y in own], 1 + t % 4, 2).items()]
    nodes.append(("leaf", 1, None, None, 1))
    return rows, nodes


NODES = "tree string, node long, feature int, threshold double, action int"


@pytest.mark.parametrize("sent", [1 << 18, 10])
def test_scores_and_sites_by_hand(spark, population, monkeypatch, sent):
    monkeypatch.setattr(forests, "SENT_NODES", sent)
    monkeypatch.setattr(forests, "BLOCK", 64)
    rows, nodes = population
    df, table = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(3), spark.createDataFrame(nodes, NODES)
    leaves = forests.leaf_counts(df, table, "tree", "x", "y")
    got = {(r.tree, r.node): r for r in forests.sites(leaves, table, "tree").collect()}
    assert set(got) == {(t, n) for t, n, *_ in nodes}
    scores = {r.tree: r for r in forests.population_scores(leaves, table, "tree", 0.01).collect()}
    labelled = [(x, y) for _, x, y in rows if y is not None]
    for t in {n[0] for n in nodes}:
        tree = {n: (f, c, a) for s, n, f, c, a in nodes if s == t}
        ends = [(walk(tree, x), y) for x, y in labelled]
        for site in tree:
            here = [(end, y) for end, y in ends if below(end, site)]
            under = [n for n in tree if below(n, site)]
            r = got[t, site]
            assert (r.node_count, r.subtree_depth, r.reached) == (len(under), max(n.bit_length() for n in under) - site.bit_length(), len(here))
            if here:
                wrong = sum(tree[end][2] != y for end, y in here)
                by = [[tree[end][2] == y for end, y in here if y == c] for c in (0, 1)]
                balanced = wrong / len(here) if not all(by) else 1 - sum(sum(b) / len(b) for b in by) / 2
                assert (r.local_error, r.balanced_error, r.class_deficient) == (round(wrong / len(here), 9), round(balanced, 9), int(not all(by)))
                assert r.reach_rate == round(len(here) / len(labelled), 9)
        assert scores[t].fitness == pytest.approx(1 - got[t, 1].balanced_error - 0.01 * len(tree), abs=1e-9)


def test_rows_that_take_a_path(spark, population):
    rows, nodes = population
    df, tree = spark.createDataFrame(rows, "id long, x array<double>, y int"), {n: (f, c, a) for t, n, f, c, a in nodes if t == "t3"}
    table = spark.createDataFrame([n for n in nodes if n[0] == "t3"], NODES)
    for path in ([], [0], [0, 1], [1, 0]):
        site = int("1" + "".join(map(str, path)), 2)
        if all(tree[site >> k][0] is not None for k in range(1, len(path) + 1)):
            want = {i for i, x, _ in rows if below(walk(tree, x), site)}
            assert {r.id for r in df.where(forests.reaches(table, path, "x")).collect()} == want
    with pytest.raises(ValueError, match="no splits"):
        forests.reaches(table, [0] * 12, "x")
    held = forests.compiled(table, ["tree"])
    joined = df.join(F.broadcast(held), F.lit(True))
    got = joined.select("id", forests.leaf(F.col("tree_nodes"), F.col("depth"), F.col("x")).alias("end"))
    assert {r.id: r.end for r in got.collect()} == {i: walk(tree, x) for i, x, _ in rows}


def test_node_tables_that_are_no_trees(spark):
    nan = float("nan")
    rows = [
        ("good", 1, 0, 0.5, 0), ("good", 2, None, None, 0), ("good", 3, None, None, 1),
        ("rootless", 2, None, None, 0), ("half", 1, 1, 0.5, 0), ("half", 2, None, None, 1),
        ("orphan", 1, None, None, 0), ("orphan", 6, None, None, 0), ("twice", 1, None, None, 0), ("twice", 1, None, None, 0),
        ("far", 1, 7, 0.5, 0), ("far", 2, None, None, 0), ("far", 3, None, None, None), ("nan", 1, 0, nan, 0), ("nan", 2, None, None, 0), ("nan", 3, None, None, 0),
    ]
    got = {tuple(r) for r in forests.violations(spark.createDataFrame(rows, NODES), ["tree"], 3).collect()}
    assert got == {("rootless", 1, "no_root"), ("rootless", 2, "no_parent"), ("half", 3, "one_child"), ("orphan", 6, "no_parent"), ("twice", 1, "repeated"), ("far", 1, "bad_split"), ("far", 3, "no_action"), ("nan", 1, "bad_split")}


def refitted_by_force(x, y, shape, cuts, depth, min_leaf, min_gain, tie, node=1):
    ones, n = sum(y), len(y)
    action = tie if 2 * ones == n else int(2 * ones > n)
    gini = lambda s: 2 * sum(s) * (len(s) - sum(s)) / len(s)
    best = None
    if 0 < ones < n and n >= 2 * min_leaf and node.bit_length() <= depth and node in shape:
        f = shape[node]
        for slot, cut in sorted(cuts.get(f, [])):
            left = [c for r, c in zip(x, y, strict=True) if f < len(r) and r[f] is not None and r[f] < cut]
            right = [c for r, c in zip(x, y, strict=True) if not (f < len(r) and r[f] is not None and r[f] < cut)]
            if min(len(left), len(right)) >= min_leaf:
                impurity = round((gini(left) + gini(right)) / n, 9)
                if gini(y) / n - impurity > min_gain and (best is None or impurity < best[0]):
                    best = impurity, f, cut
    if best is None:
        return {node: (None, None, action)}
    goes = [best[1] < len(r) and r[best[1]] is not None and r[best[1]] < best[2] for r in x]
    out = {node: (best[1], best[2], action)}
    for side in (0, 1):
        rows = [k for k, g in enumerate(goes) if g == (side == 0)]
        out |= refitted_by_force([x[k] for k in rows], [y[k] for k in rows], shape, cuts, depth, min_leaf, min_gain, tie, 2 * node + side)
    return out


@pytest.mark.parametrize(("min_leaf", "min_gain", "tie"), [(1, 1e-12, 1), (4, 0.02, 0)])
def test_a_template_keeps_its_shape(spark, min_leaf, min_gain, tie):
    rng = np.random.default_rng(12)
    rows = [(t, [float(rng.integers(0, 9)), None if rng.random() < 0.1 else float(rng.integers(0, 9))][: 1 + (rng.random() < 0.9)], int(rng.integers(0, 2))) for t in range(4) for _ in range(int(rng.integers(2, 50)))]
    shape = {1: 0, 2: 1, 3: 0, 4: 1, 5: 7}  # feature 7 has no cuts
    cuts = {0: [(3, 2.5), (1, 6.5), (2, 2.5)], 1: [(1, 4.5), (2, 1.5), (3, 100.0)]}
    template = spark.createDataFrame([*((n, f) for n, f in shape.items()), (6, None)], "node long, feature int")
    table = spark.createDataFrame([(f, s, c) for f, held in cuts.items() for s, c in held], "feature int, slot int, cut double")
    got = forests.refit_template(spark.createDataFrame(rows, "t int, x array<double>, y int"), ["t"], "x", "y", template, table, 3, min_leaf, min_gain, tie).collect()
    for t in range(4):
        x, y = [r[1] for r in rows if r[0] == t], [r[2] for r in rows if r[0] == t]
        assert {r.node: (r.feature, r.threshold, r.action) for r in got if r.t == t} == refitted_by_force(x, y, shape, cuts, 3, min_leaf, min_gain, tie)
