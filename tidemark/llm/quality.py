"""Operator 6: a quality classifier as a generalised additive model with pairwise interactions.

Features of the whole text are put into bins. Cyclic boosting visits one feature after another, fits a shallow tree over
its bins to the loss's gradient and adds a small step of it to that feature's lookup table; then the pairs that explain
most of what is left get tables of their own in the same way. A score is a sum of table entries through the logistic
function.

Learning takes place on the driver from a sample of at most `MAX_LABELLED` labelled rows (features only); scoring reads
every whole text where it lies and needs no shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import lean, small_batches, text_pieces, word_bounds, word_hashes

#: Labelled rows the model is learned from, at most.
MAX_LABELLED = 12_000

FEATURES = ("log_words", "word_length", "upper", "digits", "common_marks", "rare_marks", "exclamations", "not_ascii", "lines_per_word", "stops_per_word", "distinct_words", "repeats", "one_letter", "marked_words", "top_mark")

_BYTE = np.arange(256)
_IS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "letters": ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "common": np.isin(_BYTE, [*b".,;:'\"()-"]),
    "bang": np.isin(_BYTE, [*b"!?"]),
    "other": (_BYTE >= 128),
    "line": _BYTE == 10,
    "stop": _BYTE == 46,
}
_IS["rare"] = (_BYTE > 32) & (_BYTE < 127) & ~_IS["letters"] & ~_IS["digits"] & ~_IS["common"] & ~_IS["bang"]
_MARKS = [*b"|#$%&*~=<>_/\\{}[]@^+"]


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts give zeros."""
    rows = []
    for _, _, data, offsets in text_pieces(column):
        n = len(offsets) - 1
        out = np.zeros((n, len(FEATURES)))
        lengths = np.maximum(np.diff(offsets), 1)

        def count(mask: np.ndarray, data=data, offsets=offsets) -> np.ndarray:
            places = np.flatnonzero(mask[data])
            return np.diff(np.searchsorted(places, offsets)).astype(float)

        starts, ends, first = word_bounds(data, offsets)
        hashes, _ = word_hashes(data, offsets)
        words = np.maximum(np.diff(first), 1)
        letters, rare = count(_IS["letters"]), count(_IS["rare"])
        out[:, 0] = np.log1p(np.diff(first))
        out[:, 1] = (lengths - count(_IS["line"])) / words
        out[:, 2] = count(_IS["upper"]) / np.maximum(letters, 1)
        out[:, 3] = count(_IS["digits"]) / lengths
        out[:, 4] = count(_IS["common"]) / lengths
        out[:, 5] = rare / lengths
        out[:, 6] = count(_IS["bang"]) / words
        out[:, 7] = count(_IS["other"]) / lengths
        out[:, 8] = count(_IS["line"]) / words
        out[:, 9] = count(_IS["stop"]) / words
        owner = np.repeat(np.arange(n), np.diff(first))
        if len(hashes):
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
            out[:, 11] = np.bincount(owner[again], minlength=n) / words
            out[:, 12] = np.bincount(owner, ends - starts == 1, minlength=n) / words
            tail = data[ends - 1]
            out[:, 13] = np.bincount(owner, _IS["rare"][tail] | _IS["bang"][tail], minlength=n) / words
            out[:, 10] = [len(np.unique(hashes[a:b])) / max(b - a, 1) for a, b in zip(first[:-1], first[1:], strict=True)]
        if rare.any():
            odd = np.flatnonzero(_IS["rare"][data])
            whose = np.searchsorted(offsets, odd, "right") - 1
            kinds = np.zeros(256, np.int64)
            kinds[_MARKS] = np.arange(1, len(_MARKS) + 1)
            width = len(_MARKS) + 1
            table = np.bincount(whose * width + kinds[data[odd]], minlength=n * width).reshape(n, width)
            out[:, 14] = table.max(1) / words
        out[np.diff(offsets) == 0] = 0
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _split(gradient: np.ndarray, weight: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf value of every bin of a shallow regression tree over ordered bins."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(gradient) < 2:
        return out
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gain = g * g / (w + 1.0) + (gradient.sum() - g) ** 2 / (weight.sum() - w + 1.0)
    gain[(w < least) | (weight.sum() - w < least)] = -1
    at = int(gain.argmax())
    if gain[at] <= gradient.sum() ** 2 / (weight.sum() + 1.0) + 1e-9:
        return out
    return np.concatenate([_split(gradient[: at + 1], weight[: at + 1], depth - 1, least), _split(gradient[at + 1 :], weight[at + 1 :], depth - 1, least)])


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a pair's grid into four leaves, one cut along each axis, and its gain."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    gt, wt = g[-1, -1], w[-1, -1]
    a, wa = g[:-1, :-1], w[:-1, :-1]
    b, wb = g[:-1, -1:] - a, w[:-1, -1:] - wa
    c, wc = g[-1:, :-1] - a, w[-1:, :-1] - wa
    d, wd = gt - a - b - c, wt - wa - wb - wc
    gain = sum(x * x / (y + 5.0) for x, y in ((a, wa), (b, wb), (c, wc), (d, wd)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = np.empty_like(gradient)
    for rows, cols, x, y in ((slice(None, i + 1), slice(None, j + 1), a, wa), (slice(None, i + 1), slice(j + 1, None), b, wb), (slice(i + 1, None), slice(None, j + 1), c, wc), (slice(i + 1, None), slice(j + 1, None), d, wd)):
        leaf[rows, cols] = x[i, j] / (y[i, j] + 5.0)
    return leaf, float(gain[i, j] - gt * gt / (wt + 5.0))


class AdditiveModel:
    """Bin edges and lookup tables, one for each feature and for each chosen pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1):
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        positive = float(y.mean()) if n else 0.5
        self.base = float(np.log((positive * n + 0.5) / ((1 - positive) * n + 0.5))) if n else 0.0
        if not n or positive in (0.0, 1.0):
            return
        binned = self._bins(x)
        score = np.full(n, self.base)
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                size = len(table)
                step = rate * np.clip(_split(np.bincount(binned[j], y - p, size), np.bincount(binned[j], p * (1 - p), size), 2, 1e-3 * n**0.5), -4, 4)
                table += step
                score += step[binned[j]]
        p = 1 / (1 + np.exp(-score))
        grids = {}
        for i, j in combinations(range(k), 2):
            shape = len(self.tables[i]), len(self.tables[j])
            if min(shape) > 1:
                grids[i, j] = _quadrants(*(np.bincount(binned[i] * shape[1] + binned[j], v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))))[1]
        chosen = sorted(grids, key=lambda ij: (-grids[ij], ij))[:pairs]
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for i, j in chosen]
        for _ in range(pair_rounds):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-score))
                flat = binned[i] * table.shape[1] + binned[j]
                leaf, _ = _quadrants(*(np.bincount(flat, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p))))
                step = rate * np.clip(leaf, -4, 4)
                table += step
                score += step.ravel()[flat]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x)
        score = np.full(len(x), self.base)
        for b, table in zip(binned, self.tables, strict=True):
            score += table[b]
        for i, j, table in self.pairs:
            score += table[binned[i], binned[j]]
        return 1 / (1 + np.exp(-score))


def learning_row(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from: CRC-32 of its id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def features_of(text: Column) -> Column:
    """FEATURES of a text column as array<double>."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        lean()
        x = text_features(column)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.ravel())

    return run(text)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """Learn from labelled documents outside the held-out fifth; which of them, a hash of the id decides."""
    known = labels.where(learning_row(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", features_of(F.col("text")).alias("x"), "quality")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality")).toPandas()  # an id counts once, however many rows have it
    order = np.lexsort(np.stack(rows["x"].to_list()).T) if len(rows) else []  # rows come in any order; sums should not
    x = np.stack(rows["x"].to_list())[order] if len(rows) else np.zeros((0, len(FEATURES)))
    return AdditiveModel(x, rows["quality"].to_numpy(float)[order] if len(rows) else np.zeros(0))


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """The model's score of a text column, from 0 to 1; null and empty texts are scored by features that are all 0."""

    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        lean()
        return pa.array(model.predict(text_features(column)))

    return run(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other (all features 0). Repeated rows are each answered; a document with
    several labels counts as good if one of them says so. Rows without an id are never learned from nor held out.
    Without any label every score is 0.5; if all labels agree, their smoothed share. Other columns are not read.
    """
    scored = small_batches(docs).select("doc_id", F.coalesce(~learning_row(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), quality_score(F.col("text"), fit_quality(docs, labels)).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
