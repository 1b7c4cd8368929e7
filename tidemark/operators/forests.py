"""Many decision trees at once: grown by groups, held as node tables, and evaluated over rows.

A node table has one row for each node: the tree's columns, node (the root is 1, the children of n are 2n and 2n + 1),
feature and threshold (null at leaves; left where the value is smaller), and action (the label that rows ending there get).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stored import store
from tidemark.operators.trees import best_split, dealt, value_counts

#: Trees that are sent to every task in one go, by their nodes; more are evaluated in several passes over the rows.
SENT_NODES = 1 << 18

#: Rows that are routed through all trees at once.
BLOCK = 1 << 14


def grow_nodes(rows: DataFrame, by: list[str], vector: str, label: str, depth: int, min_leaf: int = 1) -> DataFrame:
    """The node tables of greedy trees, one for each value of `by`: also n and ones, the training rows at each node.

    All nodes of a level, of all trees, are split by one aggregation. A node is split while it holds both labels, the
    depth allows and a cut leaves `min_leaf` rows on either side. Ties of a node's action go to 0.
    """
    keys = [*by, "node"]
    base = rows.select(*by, F.col(label).alias("y"), F.col(vector).alias("vector"), F.lit(1).cast("long").alias("node"))
    levels = []
    for level in range(depth + 1):
        counts = base.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
        action = (2 * F.col("ones") > F.col("n")).cast("int").alias("action")
        if level == depth:
            levels.append(store(counts.select(*keys, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), action, "n", "ones")))
            break
        counts = store(counts)
        even, tasks = dealt(base.join(counts.where("ones > 0 and ones < n").select(*keys), keys, "left_semi"), "vector")
        long = even.select(*keys, "y", F.posexplode("vector").alias("feature", "value"))
        splits = best_split(value_counts(long, *keys, tasks=tasks), *keys, min_leaf=min_leaf).select(*keys, "feature", "threshold")
        levels.append(store(counts.join(splits, keys, "left").select(*keys, "feature", "threshold", action, "n", "ones")))
        if not levels[-1].where("feature is not null").limit(1).count():
            break
        # Rows go down by the stored splits, so that each level is one pass over them.
        left = F.get("vector", F.col("feature")) < F.col("threshold")
        base = base.join(levels[-1].where("feature is not null").select(*keys, "feature", "threshold"), keys).select(*by, "y", "vector", (2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"))
    return reduce(DataFrame.unionByName, levels)


def violations(nodes: DataFrame, by: list[str], features: int) -> DataFrame:
    """What makes node tables no trees: (by, node, rule). Nothing for sound ones.

    Rules: no_root, repeated, no_parent (or a leaf as one), one_child, bad_split (feature outside 0..features - 1, or a
    threshold that is missing or not finite), no_action (of a leaf).
    """
    keys = [*by, "node"]
    is_split = F.col("feature").isNotNull()
    here = nodes.groupBy(*keys).agg(F.count("*").alias("copies"), F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.max("action").alias("action"))
    parents = here.where(is_split).select(*by, F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"), F.lit(True).alias("expected"))
    roots = here.select(*by).distinct().withColumn("node", F.lit(1).cast("long")).withColumn("expected", F.lit(True))
    both = here.join(parents.unionByName(roots), keys, "full_outer")
    absent = F.col("copies").isNull()
    rules = {
        "no_root": absent & (F.col("node") == 1),
        "one_child": absent & (F.col("node") != 1),
        "no_parent": F.col("expected").isNull(),
        "repeated": F.col("copies") > 1,
        "bad_split": is_split & ((F.col("feature") < 0) | (F.col("feature") >= features) | F.coalesce(F.isnan("threshold") | (F.abs("threshold") == float("inf")), F.lit(True))),
        "no_action": ~absent & ~is_split & F.col("action").isNull(),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return both.select(*keys, F.explode(found).alias("rule"))


def compiled(nodes: DataFrame, by: list[str]) -> DataFrame:
    """One row a tree: by, depth, and `tree_nodes`, a map from each node to its feature, threshold and action."""
    node = F.struct("node", F.struct(F.col("feature").cast("int").alias("feature"), F.col("threshold").cast("double").alias("threshold"), F.col("action").cast("int").alias("action")).alias("at"))
    held = nodes.groupBy(*by).agg(F.floor(F.log2(F.max("node").cast("double"))).cast("int").alias("depth"), F.collect_list(node).alias("held"))
    return held.select(*by, "depth", F.map_from_entries("held").alias("tree_nodes"))


def nested(tree: DataFrame) -> dict:
    """The node table of one tree as the nested form that `trees.predict` turns into cases; its size is bounded by its depth."""
    rows = {r["node"]: r for r in tree.collect()}

    def at(node: int) -> dict:
        here = rows[node]
        if here["feature"] is None:
            return {"action": here["action"]}
        return {"feature": here["feature"], "threshold": here["threshold"], "left": at(2 * node), "right": at(2 * node + 1)}

    return at(1)


def leaf(tree: Column, depth: Column, vector: Column) -> Column:
    """The node where a row ends in its own tree, for rows joined to `compiled` trees. A missing value goes right."""

    def step(node: Column, _: Column) -> Column:
        at = tree[node]
        left = F.get(vector, at["feature"]) < at["threshold"]
        return F.when(at["feature"].isNull(), node).otherwise(2 * node + F.when(left, 0).otherwise(1))

    return F.aggregate(F.sequence(F.lit(0), depth), F.lit(1).cast("long"), lambda node, k: step(node, k))


def reaches(tree: DataFrame, path: list[int], vector: str) -> Column:
    """Whether a row of `vector` takes `path` (0 left, 1 right) in the node table of one tree: one predicate for the scan.

    The path is as long as the tree is deep, so only its own splits are looked up.
    """
    nodes, at = [], 1
    for side in path:
        nodes.append(at)
        at = 2 * at + side
    splits = {r["node"]: r for r in tree.where(F.col("node").isin(nodes)).where("feature is not null").collect()}
    if missing := [n for n in nodes if n not in splits]:
        raise ValueError(f"the path leads through nodes that are no splits: {missing}")
    out = F.lit(True)
    for node, side in zip(nodes, path, strict=True):
        left = F.coalesce(F.get(F.col(vector), F.lit(splits[node]["feature"])) < splits[node]["threshold"], F.lit(False))
        out = out & (~left if side else left)
    return out


def _flat(rows: list) -> tuple[np.ndarray, ...]:
    """Nodes of many trees as arrays: each tree's root, and each node's feature (-1 at leaves), threshold, left child, tree and number."""
    place = {(r["tree"], r["node"]): k for k, r in enumerate(rows)}
    feature = np.array([-1 if r["feature"] is None else r["feature"] for r in rows], np.int64)
    threshold = np.array([np.nan if r["threshold"] is None else r["threshold"] for r in rows], float)
    child = np.array([[place[r["tree"], 2 * r["node"] + s] if r["feature"] is not None else k for s in (0, 1)] for k, r in enumerate(rows)], np.int64).reshape(-1, 2)
    roots = np.array([k for k, r in enumerate(rows) if r["node"] == 1], np.int64)
    return roots, feature, threshold, child


def leaf_counts(rows: DataFrame, nodes: DataFrame, tree: str, vector: str, label: str) -> DataFrame:
    """(tree, node, zeros, ones): rows of each label that end at each leaf of each tree, over all rows.

    The trees are sent to the tasks, which route blocks of rows through all of them level by level and add up; a task
    returns one row a leaf, and no row meets a tree in a join. Beyond SENT_NODES nodes the trees go in several passes.
    Rows without a label count nowhere; a missing value goes right.
    """
    sizes = nodes.groupBy(tree).count().orderBy(tree).collect()  # a row a tree
    passes, room = [], 0
    for r in sizes:
        if r["count"] > room:
            passes.append([])
            room = SENT_NODES
        passes[-1].append(r[tree])
        room -= r["count"]
    kind = nodes.schema[tree].dataType.simpleString()
    out = None
    for trees in passes:
        held = nodes.where(F.col(tree).isin(trees)).select(F.col(tree).alias("tree"), "node", "feature", "threshold").collect()
        sent = rows.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            roots, feature, threshold, child = _flat(held)
            counts = np.zeros((2, len(held)), np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(low, BLOCK)
                    y = part.column(1).to_numpy(zero_copy_only=False)
                    lists = part.column(0)
                    width = int(max([0, *(len(v) for v in lists if v.is_valid)]))
                    x = np.full((len(y), width + 1), np.nan)  # one more: of features that no row has
                    for k, v in enumerate(lists.to_pylist()):
                        if v:
                            x[k, : len(v)] = v
                    rows_at = np.arange(len(y))
                    for root in roots.tolist():
                        at = np.full(len(y), root)
                        while (inner := feature[at] >= 0).any():
                            left = x[rows_at, np.minimum(feature[at], width)] < threshold[at]
                            at = np.where(inner, child[at, np.where(left, 0, 1)], at)
                        counts[0] += np.bincount(at[y == 0], minlength=len(held))
                        counts[1] += np.bincount(at[y == 1], minlength=len(held))
            some = np.flatnonzero(counts.any(0))
            yield pa.RecordBatch.from_arrays([pa.array([held[k]["tree"] for k in some]), pa.array([held[k]["node"] for k in some], pa.int64()), pa.array(counts[0, some]), pa.array(counts[1, some])], [tree, "node", "zeros", "ones"])

        one = rows.where(F.col(label).isin(0, 1)).select(F.col(vector).cast("array<double>"), F.col(label).cast("int")).mapInArrow(run, f"{tree} {kind}, node bigint, zeros bigint, ones bigint")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return nodes.select(tree, "node", F.lit(0).cast("long").alias("zeros"), F.lit(0).cast("long").alias("ones")).limit(0)
    return out.groupBy(tree, "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def sites(leaves: DataFrame, nodes: DataFrame, tree: str) -> DataFrame:
    """What is known of each node of each tree from the rows that reach it.

    Columns: tree, node, node_count and subtree_depth (of its subtree), reached, reach_rate (of the rows at the root),
    local_error, balanced_error (the plain error where a label is missing), class_deficient. A row reaches a node when its
    leaf is below it, so leaves' counts are added up along their ancestors; rows themselves are not looked at again. Nodes
    that no row reaches have null rates.
    """
    # A node's ancestors are its number halved again and again.
    above = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("node").cast("double"))).cast("int")), lambda k: F.call_function("shiftright", F.col("node"), k))
    levels = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    shape = nodes.select(tree, F.col("node").alias("below"), levels.alias("level"), F.explode(above).alias("node"))
    shape = shape.groupBy(tree, "node").agg(F.count("*").alias("node_count"), (F.max("level") - F.min("level")).alias("subtree_depth"))
    right = F.when(F.col("action") == 1, F.col("ones")).otherwise(0), F.when(F.col("action") == 0, F.col("zeros")).otherwise(0)
    ends = leaves.join(nodes.select(tree, "node", "action"), [tree, "node"]).select(tree, F.explode(above).alias("node"), "zeros", "ones", right[0].alias("right_1"), right[1].alias("right_0"))
    sums = ends.groupBy(tree, "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "right_0", "right_1")))
    whole = sums.where("node = 1").select(tree, (F.col("zeros") + F.col("ones")).alias("all_rows"))
    found = shape.join(sums, [tree, "node"], "left").join(whole, tree, "left")
    zeros, ones = (F.coalesce(F.col(c), F.lit(0)) for c in ("zeros", "ones"))
    reached = zeros + ones
    error = (reached - F.col("right_0") - F.col("right_1")) / F.nullif(reached, F.lit(0))
    deficient = (zeros == 0) | (ones == 0)
    balanced = 1 - 0.5 * (F.col("right_0") / F.nullif(zeros, F.lit(0)) + F.col("right_1") / F.nullif(ones, F.lit(0)))
    return found.select(tree, "node", "node_count", "subtree_depth", reached.alias("reached"), F.round(reached / F.col("all_rows"), 9).alias("reach_rate"), F.round(error, 9).alias("local_error"), F.round(F.when(deficient, error).otherwise(balanced), 9).alias("balanced_error"), deficient.cast("int").alias("class_deficient"))


def population_scores(leaves: DataFrame, nodes: DataFrame, tree: str, penalty: float = 0.00025) -> DataFrame:
    """Each tree's accuracy, nodes and fitness: balanced accuracy (the plain one where a label is missing) less `penalty` a node."""
    root = sites(leaves, nodes, tree).where("node = 1")
    fitness = 1 - F.col("balanced_error") - penalty * F.col("node_count")
    return root.select(tree, F.col("node_count").alias("nodes"), F.round(1 - F.col("local_error"), 9).alias("accuracy"), F.round(fitness, 9).alias("fitness"), "class_deficient")


def refit_template(rows: DataFrame, by: list[str], vector: str, label: str, template: DataFrame, cuts: DataFrame, depth: int, min_leaf: int = 1, min_gain: float = 1e-12, tie_action: int = 1) -> DataFrame:
    """The node tables of trees that take their shape from one template, a tree for each value of `by`; as `grow_nodes` gives them.

    template: (node, feature) of the template's splits, its shape; leaves are left out. cuts: (feature, slot, cut), the
    thresholds that a split may take, a few for each feature; of equally good ones the lowest slot wins. A node is split on the
    template's feature while it holds both labels, has at least 2 `min_leaf` rows, and a cut leaves `min_leaf` rows on both
    sides and lowers Gini's impurity by more than `min_gain`; else it is a leaf, whatever the template has below it. Ties of an action
    go to `tie_action`. A missing value goes right.

    Rows are counted by bins between the sorted cuts, so what is swept is bounded by the number of cuts and not by that of values.
    """
    keys = [*by, "node"]
    held = F.sort_array(F.collect_list(F.struct(F.col("cut").alias("cut"), F.col("slot").cast("int").alias("slot"))))
    shape = store(template.where("feature is not null").select("node", F.col("feature").cast("int").alias("feature")).join(cuts.groupBy(F.col("feature").cast("int").alias("feature")).agg(held.alias("cuts")), "feature"))
    base = rows.select(*by, F.col(label).alias("y"), F.col(vector).alias("vector"), F.lit(1).cast("long").alias("node"))
    gini = lambda n, ones: 2 * ones * (n - ones) / n  # noqa: E731  n times Gini's impurity
    levels = []
    for level in range(depth + 1):
        counts = base.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
        tied = 2 * F.col("ones") == F.col("n")
        action = F.when(tied, tie_action).otherwise((2 * F.col("ones") > F.col("n")).cast("int")).alias("action")
        if level == depth:
            levels.append(store(counts.select(*keys, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), action, "n", "ones")))
            break
        open_ = counts.where((F.col("ones") > 0) & (F.col("ones") < F.col("n")) & (F.col("n") >= 2 * min_leaf)).select(*keys, "n", "ones")
        value = F.get("vector", F.col("feature"))
        # A row is left of every cut above its value: of all but the first `bin` ones. Missing values are left of none.
        place = F.when(value.isNull(), F.size("cuts")).otherwise(F.size(F.filter("cuts", lambda c: c["cut"] <= value)))
        binned = base.join(shape, "node").withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.sum("y").alias("o"))
        each = open_.join(shape, "node").select(*keys, "feature", "n", "ones", F.posexplode("cuts").alias("place", "at"))
        swept = each.join(binned, keys).where("bin <= place").groupBy(*keys, "feature", "n", "ones", "place", "at").agg(F.sum("m").alias("nl"), F.sum("o").alias("ol"))
        nr, right = F.col("n") - F.col("nl"), F.col("ones") - F.col("ol")
        swept = swept.where((F.col("nl") >= min_leaf) & (nr >= min_leaf)).withColumn("impurity", F.round((gini(F.col("nl"), F.col("ol")) + gini(nr, right)) / F.col("n"), 9))
        swept = swept.where(gini(F.col("n"), F.col("ones")) / F.col("n") - F.col("impurity") > min_gain)
        best = swept.groupBy(*keys).agg(F.min_by(F.struct("feature", F.col("at.cut").alias("threshold")), F.struct("impurity", "at.slot")).alias("best")).select(*keys, "best.*")
        levels.append(store(counts.join(best, keys, "left").select(*keys, "feature", "threshold", action, "n", "ones")))
        splits = levels[-1].where("feature is not null").select(*keys, "feature", "threshold")
        if not splits.limit(1).count():
            break
        left = F.get("vector", F.col("feature")) < F.col("threshold")
        base = base.join(splits, keys).select(*by, "y", "vector", (2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"))
    return reduce(DataFrame.unionByName, levels)
