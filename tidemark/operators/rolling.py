"""Trees that are refitted along a stream: each predicts the rows after its training rows, until the next one is fitted.

Of a key's rows 1, 2, ..., the first tree learns from the warm-up rows and predicts those after. With a cadence, a new tree
is fitted whenever `every` more rows have been seen, from the last `window` of them; a row is always predicted before it
is learned from. Fitting needs a bounded stretch of rows, so a key's history is dealt into overlapping chunks of at most
two windows: each row is copied to two of them, whatever the cadence, and no chunk grows with the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators import forests

#: The chunk of the rows before the first prediction.
WARM = -1

#: Trees that are fitted side by side.
TOGETHER = 1024


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int | None = None, min_leaf: int = 1) -> Iterator[tuple[int, int | None, float | None, int]]:
    """(node, feature, threshold, action) of the greedy Gini tree of a few rows, by the rules of `forests.grow_nodes`."""
    todo = [(1, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        ones, n = int(y[rows].sum()), len(rows)
        action = int(2 * ones > n)
        best = None
        if 0 < ones < n and (depth is None or node.bit_length() <= depth):
            order = np.argsort(x[rows], axis=0, kind="stable")
            values = np.take_along_axis(x[rows], order, 0)
            left_n = np.arange(1, n)[:, None]
            left_1 = np.cumsum(y[rows][order], axis=0)[:-1]
            right_n, right_1 = n - left_n, ones - left_1
            impurity = np.round((2 * left_1 * (left_n - left_1) / left_n + 2 * right_1 * (right_n - right_1) / right_n) / n, 9)
            impurity[(values[1:] == values[:-1]) | (left_n < min_leaf) | (right_n < min_leaf)] = np.inf
            flat = int(np.argmin(impurity.T))  # the first feature, then the first place
            feature, place = divmod(flat, n - 1)
            if np.isfinite(impurity[place, feature]):
                a, b = values[place, feature], values[place + 1, feature]
                middle = a / 2 + b / 2
                best = feature, float(middle if a < middle <= b else b)
        if best is None:
            yield node, None, None, action
        else:
            yield node, *best, action
            left = x[rows, best[0]] < best[1]
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]


def fit_trees(x: np.ndarray, y: np.ndarray, held: np.ndarray, depth: int | None = None, min_leaf: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """`fit_tree` of many trees side by side: (tree, node, feature, threshold, action) of a level's nodes at a time.

    x is (tree, row, feature), y (tree, row), and held (tree, row) says which rows a tree learns from; feature is -1 at a
    leaf. What isn't held must not be NaN.
    """
    order = np.argsort(np.where(held[:, :, None], x, np.inf), axis=1, kind="stable").transpose(0, 2, 1)  # (tree, feature, place)
    values = np.take_along_axis(x.transpose(0, 2, 1), order, 2)
    places, k = x.shape[1], x.shape[2]
    tree, node, rows = np.arange(len(x)), np.ones(len(x), np.int64), held
    while len(tree):
        n, ones = rows.sum(1), np.where(rows, y[tree], 0).sum(1)
        action, feature, threshold = (2 * ones > n).astype(np.int32), np.full(len(tree), -1, np.int32), np.full(len(tree), np.nan)
        level = int(node[0]).bit_length()
        split = np.flatnonzero((ones > 0) & (ones < n)) if depth is None or level <= depth else np.empty(0, np.int64)
        if len(split):
            t = tree[split]
            into = np.take_along_axis(np.broadcast_to(rows[split][:, None, :], (len(t), k, places)), order[t], 2)
            left_n = np.cumsum(into, axis=2)
            left_1 = np.cumsum(np.where(into, np.take_along_axis(np.broadcast_to(y[t][:, None, :], into.shape), order[t], 2), 0), axis=2)
            # The next value of the node after each place: values ascend, so it is the least of those that follow.
            after = np.full(into.shape, np.inf)
            after[:, :, :-1] = np.minimum.accumulate(np.where(into, values[t], np.inf)[:, :, :0:-1], axis=2)[:, :, ::-1]
            all_n, all_1 = n[split][:, None, None], ones[split][:, None, None]
            right_n, right_1 = all_n - left_n, all_1 - left_1
            fits = into & (right_n > 0) & (after != values[t]) & (left_n >= min_leaf) & (right_n >= min_leaf)
            impurity = np.round((2 * left_1 * (left_n - left_1) / np.maximum(left_n, 1) + 2 * right_1 * (right_n - right_1) / np.maximum(right_n, 1)) / all_n, 9)
            flat = np.where(fits, impurity, np.inf).reshape(len(t), -1)  # the first feature, then the first place
            best = flat.argmin(1)
            at = np.arange(len(t))
            found = np.isfinite(flat[at, best])
            split, t, best, at = split[found], t[found], best[found], at[found]
            f, place = np.divmod(best, places)
            a, b = values[t, f, place], after[at, f, place]
            middle = a / 2 + b / 2
            feature[split], threshold[split] = f, np.where((a < middle) & (middle <= b), middle, b)
        yield tree, node, feature, threshold, action
        goes = x[tree[split], :, feature[split]] < threshold[split][:, None]
        tree, node, rows = np.concatenate([tree[split]] * 2), np.concatenate([2 * node[split], 2 * node[split] + 1]), np.concatenate([rows[split] & goes, rows[split] & ~goes])


def refits(rows: DataFrame, key: str, seq: str, vector: str, label: str, warmup: int, window: int | None = None, every: int | None = None, depth: int | None = None, min_leaf: int = 1) -> DataFrame:
    """The node tables of all trees: key, refit (0 is the warm-up's), node, feature, threshold, action, fitted_at.

    `seq` counts a key's rows from 0 without gaps. `fitted_at` is how many rows had been seen; a tree is there only when
    that many were. Rows with a missing feature or label are passed over by training, but count as seen; a tree without
    any training row predicts 0.
    """
    index = F.col(seq) + 1
    chunks = F.when(index <= warmup, F.array(F.lit(WARM).cast("long"))).otherwise(F.array().cast("array<long>"))
    per = max(1, (window or 1) // (every or 1))  # refits of a chunk
    if every:
        # Refit r >= 1 learns from rows warmup + r * every - window + 1 .. warmup + r * every.
        first = F.greatest(F.ceil((index - warmup) / every), F.lit(1))
        last = F.floor((index - warmup + window - 1) / every)
        of = lambda r: F.floor((r - 1) / per).cast("long")
        chunks = F.when(last >= first, F.concat(chunks, F.sequence(of(first), of(last)))).otherwise(chunks)
    dealt = rows.select(F.col(key).alias("key"), F.explode(chunks).alias("chunk"), index.cast("long").alias("at"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    whole = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.col("y").isNotNull()
    row = F.struct("at", F.when(whole, F.col("x")).alias("x"), F.when(whole, F.col("y")).alias("y"))
    grouped = dealt.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # A chunk has at most two windows of rows, or the warm-up's; each of its trees takes its own.
    end = warmup + F.col("refit") * (every or 0)
    own = F.when(F.col("chunk") == WARM, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col("chunk") * per + 1, (F.col("chunk") + 1) * per))
    reached = F.element_at("rows", -1)["at"]
    asked = grouped.select("key", "rows", reached.alias("last"), F.explode(own).alias("refit")).withColumn("fitted_at", end.cast("long")).where(F.col("fitted_at") <= F.col("last"))
    since = F.when(F.col("refit") == 0, F.lit(0)).otherwise(F.col("fitted_at") - (window or 0))
    learned = F.filter("rows", lambda v: v["x"].isNotNull() & (v["at"] > F.col("since")) & (v["at"] <= F.col("fitted_at")))
    sets = asked.withColumn("since", since).select("key", "refit", "fitted_at", learned.alias("rows"))
    bare = sets.select("key", "refit", "fitted_at", F.transform("rows", lambda v: v["x"]).alias("x"), F.transform("rows", lambda v: v["y"]).alias("y"))
    kind = rows.schema[key].dataType
    names, types = ["key", "refit", "node", "feature", "threshold", "action", "fitted_at"], [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64()]

    def grow(part: pa.RecordBatch) -> pa.RecordBatch:
        n, vectors = pc.list_value_length(part.column("y")).to_numpy(), part.column("x").flatten()
        wide = pc.list_value_length(vectors).to_numpy()
        held = np.arange(max(int(n.max()), 1)) < n[:, None]
        k = int(wide.max(initial=1))
        widths = np.zeros(held.shape, np.int64)
        widths[held] = wide
        if (held & (widths != widths[:, :1])).any():
            raise ValueError("vectors of one tree differ in length")
        known = np.zeros((len(wide), k))
        known[np.arange(k) < wide[:, None]] = vectors.flatten().to_numpy()  # a feature that a key lacks is constant, so no tree splits on it
        padded, label = np.zeros((*held.shape, k)), np.zeros(held.shape, np.int64)
        padded[held], label[held] = known, part.column("y").flatten().to_numpy()
        tree, node, feature, threshold, action = map(np.concatenate, zip(*fit_trees(padded, label, held, depth, min_leaf), strict=True))
        leaf = feature < 0
        columns = [part.column("key").take(pa.array(tree)), part.column("refit").take(pa.array(tree)), pa.array(node), pa.array(feature, mask=leaf), pa.array(threshold, mask=leaf), pa.array(action), part.column("fitted_at").take(pa.array(tree))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                yield grow(batch.slice(low, TOGETHER))

    return bare.mapInArrow(run, f"key {kind.simpleString()}, refit bigint, node bigint, feature int, threshold double, action int, fitted_at bigint")


def predictions(rows: DataFrame, trees: DataFrame, key: str, seq: str, vector: str, warmup: int, every: int | None = None) -> DataFrame:
    """`rows` after the warm-up with refit, fitted_at and pred: each predicted by the newest tree that had not seen it.

    Rows meet their tree by key and refit; without a cadence all of a key's rows meet one tree, and a hot key's rows are
    split by the adaptive join, as the tree is one row. Trees are walked by built-in functions.
    """
    held = forests.compiled(trees, ["key", "refit", "fitted_at"]).withColumnRenamed("key", "its_key").withColumnRenamed("refit", "its_refit")
    refit = F.floor((F.col(seq) - warmup) / every).cast("long") if every else F.lit(0).cast("long")
    after = rows.where(F.col(seq) >= warmup).withColumn("refit", refit)
    joined = after.join(held, F.col(key).eqNullSafe(F.col("its_key")) & (F.col("refit") == F.col("its_refit")))
    at = forests.leaf(F.col("tree_nodes"), F.col("depth"), F.col(vector))
    return joined.withColumn("pred", F.col("tree_nodes")[at]["action"]).drop("its_key", "its_refit", "tree_nodes", "depth")


def prequential(rows: DataFrame, key: str, seq: str, vector: str, label: str, warmup: int, window: int | None = None, every: int | None = None, depth: int | None = None, min_leaf: int = 1) -> DataFrame:
    """Train and predict in turn: `predictions` of the trees of `refits`; without `every`, the warm-up's tree predicts all."""
    trees = refits(rows, key, seq, vector, label, warmup, window, every, depth, min_leaf)
    return predictions(rows, trees, key, seq, vector, warmup, every)


def loss_summary(scored: DataFrame, key: str, label: str) -> DataFrame:
    """For each key: prediction_calls, trees used, loss_sum and mean_loss. A missing prediction or label is a loss."""
    lost = F.coalesce((F.col("pred") != F.col(label)).cast("int"), F.lit(1))
    return scored.groupBy(key).agg(F.count("*").alias("prediction_calls"), F.count_distinct("refit").alias("trees"), F.sum(lost).alias("loss_sum"), F.round(F.avg(lost), 9).alias("mean_loss"))
