"""Operators 1 and 7: exact top-k search by term-at-a-time accumulation, and a permutation index.

Both search a query set among all rows in blocks. Rows are dealt into candidate blocks and queries into query blocks, of
a fixed number of rows each, by a hash of the id. One task answers one query block against one candidate block, so what
it holds is bounded whatever the input's size, and it returns k rows a query. The k best over all blocks follow from a
ranking whose groups have k rows a block.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import lean

#: Rows of a candidate block and of a query block, about. Candidates are shuffled once for each query block.
CANDIDATES, QUERIES = 2048, 4096


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in rising order, vectors padded with zeros to the longest, and the vectors' lengths."""
    ids = table.column("vec_id").to_numpy()
    column = table.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(ids), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order], lengths[order]


def search_blocks(rows: DataFrame, every: int, k: int, answer: Callable, best: str, score_type: str) -> DataFrame:
    """Answer the rows whose id is divisible by `every` against all rows; `answer` takes two Arrow tables of a pair of blocks.

    Rows without an id take no part. Of queries with one id, the least vector counts; as candidates they all count, and
    are dealt apart, so that an id which many rows have fills no block.
    """
    rows = rows.where("vec_id is not null")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n_candidates, n_queries = max(1, ceil(counts["n"] / CANDIDATES)), max(1, ceil(counts["q"] / QUERIES))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        salt = F.monotonically_increasing_id() if own == "c" else F.lit(0)
        placed = df.withColumn(own, F.pmod(F.xxhash64("vec_id", salt), F.lit(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(rows, "c", n_candidates, "q", n_queries).groupBy("c", "q")
    right = dealt(asked, "q", n_queries, "c", n_candidates).groupBy("c", "q")

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        lean()
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64() if score_type == "long" else pa.float64())})
        return answer(candidates, queries) if candidates.num_rows and queries.num_rows else empty

    found = left.cogroup(right).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").desc() if best == "highest" else F.col("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---- exact top-k -----------------------------------------------------------------------------------------------------


def accumulate(postings: list[tuple[int, np.ndarray, np.ndarray]], queries: np.ndarray, n: int) -> np.ndarray:
    """Term at a time: each query's weight of a term, times the posted weights, scattered into its dense row of scores."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for term, places, weights in postings:
        asking = np.flatnonzero(queries[:, term])
        if len(asking) == len(queries) and len(places) == n:
            scores += queries[:, term, None] * weights
        elif len(asking):
            scores[np.ix_(asking, places)] += queries[asking, term, None] * weights
    return scores


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids: a partition finds the k-th score, no full sort. Ids rise."""
    if len(scores) <= k:
        return np.lexsort((ids, -scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    level = np.flatnonzero(scores == least)[: k - len(above)]
    places = np.concatenate([above, level])
    return places[np.lexsort((ids[places], -scores[places]))]


def exact_top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Components become floor(scale * x). Queries are rows whose id is divisible by `every`; candidates are all rows with
    another id. Vectors null or with a null or non-finite component, and rows without an id, take no part. An empty
    vector scores 0 with all; of two lengths the shorter is read as padded with zeros. Repeated rows are candidates
    each, one query together. Scores beyond the range of long become its ends. An empty table gives no rows; other
    columns are not read.
    """

    def integers(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = np.floor(x * scale)
        if np.isfinite(y).all():
            return y
        # Beyond the range of doubles: such components are whole numbers, and Python's integers have no end.
        return np.frompyfunc(lambda v: floor(v * scale) if abs(v) < 2**53 else int(v) * scale, 1, 1)(x)

    def answer(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, c, _ = _arrays(candidates)
        asked, q, _ = _arrays(queries)
        c, q = integers(c), integers(q)
        dims = min(c.shape[1], q.shape[1])
        c, q = c[:, :dims], q[:, :dims]
        most = [0 if x.dtype == object else float(np.abs(x).max(initial=0)) for x in (c, q)]
        top = float("inf") if object in (c.dtype, q.dtype) else most[0] * most[1] * max(dims, 1)
        kind = np.int32 if top < 2**31 else np.int64 if top < 2**62 else object  # objects: Python's unbounded integers
        if kind is object:
            c, q = np.frompyfunc(int, 1, 1)(c), np.frompyfunc(int, 1, 1)(q)
        else:
            c, q = c.astype(kind), q.astype(kind)
        postings = [(t, places, c[places, t]) for t in range(dims) if len(places := np.flatnonzero(c[:, t]))]
        scores = accumulate(postings, q, len(ids))
        if kind is object:
            scores = np.clip(scores, -(2**63), 2**63 - 1)
        scores = scores.astype(np.int64)
        out = []
        for i, row in zip(asked, scores, strict=True):
            own = slice(*np.searchsorted(ids, [i, i + 1]))
            if own.start < own.stop:
                others = np.r_[0 : own.start, own.stop : len(ids)]
                places = others[top_k(row[others], ids[others], k)]
            else:
                places = top_k(row, ids, k)
            out.append((np.full(len(places), i), ids[places], row[places]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(whole(F.col("vector")))
    return search_blocks(rows, every, k, answer, "highest", "long")


TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


# ---- permutation index -----------------------------------------------------------------------------------------------


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector, the pivots from nearest to farthest (ties to the earlier pivot)."""
    distance = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")


def ranks(order: np.ndarray) -> np.ndarray:
    """For each vector, the place of every pivot in its order."""
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], axis=1)
    return out


def post(order: np.ndarray, prefix: int) -> list[np.ndarray]:
    """Inverted files: for each pivot, the vectors that have it among their `prefix` nearest."""
    pivot, owner = order[:, :prefix].ravel(), np.repeat(np.arange(len(order)), min(prefix, order.shape[1]))
    by = np.argsort(pivot, kind="stable")
    ends = np.searchsorted(pivot[by], np.arange(order.shape[1] + 1))
    return [owner[by[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Footrule distance of one order's ranks to those of others: how far the pivots stand from their places, in all."""
    return np.abs(a - b).sum(1, dtype=np.int32)


def permutation_search(embeddings: DataFrame, k: int = 10, every: int = 100, n_pivots: int = 256, prefix: int = 16, share: float = 0.1, least: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest vectors found: query_id, rank, vec_id, score (Euclidean distance, double precision).

    Pivots are `n_pivots` rows, taken by a hash of the id, copies left out: the index's only fitted part, of bounded size.
    Every row is represented by its pivots in order of nearness and posted in the inverted files of its `prefix` nearest,
    block by block. A query visits the files of its own `prefix` nearest pivots and no others, ranks what it finds there by
    the footrule distance of the whole orders, and measures the nearest `share` of it (`least` rows at least). Where a
    block's files hold fewer than k + `least` rows for a query, the rest of the block is visited too, so that each query
    has k answers where there are so many rows.

    Queries are rows whose id is divisible by `every`; candidates all rows with another id; ties go to the smaller vec_id.
    Vectors null, zero, empty, or with a null or non-finite component, and rows without an id, take no part; of two lengths
    the shorter is read as padded with zeros. Components so large that squares overflow give an infinite score. Repeated
    rows are candidates each, one query together. An empty table gives no rows; other columns are not read.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(whole(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    sample = rows.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * n_pivots).collect()
    width = max((len(r["vector"]) for r in sample), default=0)
    different = dict.fromkeys(tuple(r["vector"] + [0.0] * (width - len(r["vector"]))) for r in sample)
    pivots = np.array([*different][:n_pivots]).reshape(min(len(different), n_pivots), width)

    def fitted(x: np.ndarray, to: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, to - x.shape[1])))

    def answer(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, c, _ = _arrays(candidates)
        asked, q, _ = _arrays(queries)
        dims = max(c.shape[1], q.shape[1], width)
        c, q, p = fitted(c, dims), fitted(q, dims), fitted(pivots, dims)
        with np.errstate(over="ignore", invalid="ignore"):
            order, asking = orders(c, p), orders(q, p)
            files, places, own_places = post(order, prefix), ranks(order), ranks(asking)
            out = []
            for i, vector, wanted, own in zip(asked, q, asking, own_places, strict=True):
                visited = np.zeros(len(ids), bool)
                for pivot in wanted[:prefix]:
                    visited[files[pivot]] = True
                if visited.sum() < k + least:
                    visited[:] = True
                visited[slice(*np.searchsorted(ids, [i, i + 1]))] = False
                near = np.flatnonzero(visited)  # ids rise, so ties go to smaller ids
                most = max(least, k, ceil(share * len(near)))
                if most < len(near):
                    rank = footrule(places[near], own).astype(np.int64) * len(near) + np.arange(len(near))
                    near = np.sort(near[np.argpartition(rank, most)[:most]])
                distance = np.sqrt(((c[near] - vector) ** 2).sum(1))
                best = top_k(-distance, ids[near], k)
                out.append((np.full(len(best), i), ids[near][best], distance[best]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return search_blocks(rows, every, k, answer, "lowest", "double")
