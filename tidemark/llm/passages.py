"""Operator 5: near-duplicate passages by compact windows.

A text is its sequence of shingles of five words. For one hash function, the Cartesian tree of the shingles' hashes has a
node for every place c; all stretches that lie in the node's range and hold c have their minimum there, so a compact
window (c, left, right) stands for all of them. Only nodes whose range is at least as long as the shortest passage count,
about two for each such length. Windows of one hash function with the same minimum in two documents share signatures;
where windows of enough hash functions cover the same stretch, it is a candidate, and the two texts are compared.

Windows of one minimum are joined with the first document that has it, not with each other, so a passage in any number of
documents gives one pair for each. That first document may hold the minimum and not the passage. So what is still
uncovered then is taken stretch by stretch: where a window that met an earlier document is not inside a passage found,
every stretch of the shortest length that its minimum stands for, in every document that has this minimum, is hashed
whole, and documents meet the first one that has the same stretch. No equal passage is lost, however the minima fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import give_back, lean, mix64, only, small_batches, store, text_pieces, word_hashes

#: Hash functions, and how many of them must agree on a stretch.
HASHES, ENOUGH = 4, 2

FOUND = "doc_id long, start long, end long, first_doc_id long, first_start long, first_end long, similarity double"


def _sequence(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in their order, row after row, and where each row's begin (one more at the end)."""
    n = len(words)
    full = np.full(max(n - k + 1, 0), k, np.uint64)
    for j in range(k if n >= k else 0):
        full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    counts = np.maximum(np.diff(first) - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    places = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], counts)
    return full[places], starts


def _sliding(values: np.ndarray, width: int, what) -> np.ndarray:
    """The least or greatest of every `width` neighbours, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = what(out[:-step], out[step:])
        reach += step
    return out


def _nearest(values: np.ndarray, owner: np.ndarray, strict: bool) -> np.ndarray:
    """For each entry the nearest earlier one of its row that is smaller (or, if not strict, as small); -1 if none."""
    near = np.arange(-1, len(values) - 1)
    near[np.r_[True, owner[1:] != owner[:-1]] if len(owner) else []] = -1
    active = np.flatnonzero(near >= 0)
    while len(active):
        at = near[active]
        larger = values[at] >= values[active] if strict else values[at] > values[active]
        active = active[larger]
        near[active] = near[near[active]]
        active = active[near[active] >= 0]
    return near


def compact_windows(tokens: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each hash function: (minimum, row, place in the row, reach to the left, reach to the right) of all windows of `width` or more."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for j in range(HASHES):
        if len(tokens) < width:
            return
        values = mix64(tokens ^ mix64(np.full(1, j + 1, np.uint64)))
        least = _sliding(values, width, np.minimum)
        least[owner[: len(least)] != owner[width - 1 :]] = 0  # a stretch lies in one document
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        places = np.flatnonzero(_sliding(padded, width, np.maximum) == values)
        v, o = values[places], owner[places]
        before = _nearest(v, o, strict=False)
        after = _nearest(v[::-1], o[::-1], strict=True)[::-1]
        left = np.where(before >= 0, places[before] + 1, starts[o])
        right = np.where(after >= 0, places[np.minimum(len(v) - 1 - after, len(v) - 1)], starts[o + 1]) - 1
        keep = right - left + 1 >= width
        c = places[keep]
        yield v[keep], o[keep], c - starts[o[keep]], c - left[keep], right[keep] - c


#: A window as it is stored: the place of its minimum among the document's shingles, and its reach to both sides.
WINDOW = "key long, doc_id long, hash byte, place int, left int, right int"


def windows(docs: DataFrame, k: int, width: int) -> DataFrame:
    """WINDOW rows of all compact windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        names = [f.split()[0] for f in WINDOW.split(", ")]
        for batch in batches:
            for low, high, data, offsets in text_pieces(batch.column(1)):
                ids = batch.column(0).slice(low, high - low).to_numpy(zero_copy_only=False)
                tokens, starts = _sequence(*word_hashes(data, offsets), k)
                for j, (value, row, *spot) in enumerate(compact_windows(tokens, starts, width)):
                    key = mix64(value + np.uint64(j)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(np.full(len(row), j, np.int8)), *(pa.array(x.astype(np.int32)) for x in spot)], names)
        give_back()

    return docs.mapInArrow(run, WINDOW)


def first_holders(found: DataFrame) -> DataFrame:
    """(key, first): each key's smallest document, of the keys that several documents have."""
    return found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """(first, doc_id) where windows of ENOUGH hash functions that share their minimum cover a stretch together. `met` are windows with their minimum's first holder."""
    pairs = met.groupBy("first", "doc_id").agg(F.collect_list(F.struct("hash", "place", "left", "right")).alias("spots"))
    pairs = pairs.where(F.size(F.array_distinct(F.transform("spots", lambda s: s["hash"]))) >= ENOUGH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            yield batch.select(["first", "doc_id"]).filter(pa.array(meet(batch.column(2))))
        give_back()

    return small_batches(pairs).mapInArrow(run, "first long, doc_id long")


def met_minima(holders: DataFrame, width: int) -> DataFrame:
    """(key, doc_id): for each two minima, of different hash functions, that are those of one stretch of `width` shingles, a hash of both.

    Of one hash function every stretch has one minimum, so windows are runs of stretches' starts that don't overlap, and
    the pairs are no more than the windows of both. A document's windows meet in one row.
    """
    start = F.greatest(F.col("place") - F.col("left"), F.col("place") - (width - 1)), F.least(F.col("place"), F.col("place") + F.col("right") - (width - 1))
    spots = holders.groupBy("doc_id").agg(F.collect_set(F.struct("key", "hash", start[0].alias("low"), start[1].alias("high"))).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            key, hash_, low, high = (x.to_numpy() for x in lists.flatten().flatten())
            base = owner.astype(np.int64) << 32  # Fixed value: places are 32 bits.
            low, high = base + low, base + high
            sides = []
            for j in range(HASHES):
                at = np.flatnonzero(hash_ == j)
                sides.append(at[np.argsort(low[at], kind="stable")])
            for i in range(HASHES):
                for j in range(i + 1, HASHES):
                    a, b = sides[i], sides[j]
                    # Windows of texts with one id may overlap, so ends are taken as the furthest so far, and looked at again.
                    first = np.searchsorted(np.maximum.accumulate(high[b]), low[a]) if len(b) else np.zeros(len(a), np.int64)
                    n = np.maximum(np.searchsorted(low[b], high[a], "right") - first, 0)
                    one = np.repeat(a, n)
                    two = b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] if n.sum() else b[:0]
                    true = high[two] >= low[one]
                    one, two = one[true], two[true]
                    both = mix64(key[one].view(np.uint64) ^ mix64(key[two].view(np.uint64) + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(ids[owner[one]])], ["key", "doc_id"])
        give_back()

    return small_batches(spots).mapInArrow(run, "key long, doc_id long")


def stretch_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of the stretch of `width` shingles that starts at each place, put together from those of 1, 2, 4, ... shingles."""
    n, at, size, blocks = len(tokens) - width + 1, 0, 1, tokens
    out = np.full(max(n, 0), width, np.uint64)
    while n > 0 and at < width:
        if width & size:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + blocks[at : at + n])
            at += size
        if at < width:
            blocks = mix64(blocks[:-size] * np.uint64(0x9E3779B97F4A7C15) + blocks[size:])
            size *= 2
    return out


def stretches(spots: DataFrame, docs: DataFrame, k: int, width: int) -> DataFrame:
    """(key, doc_id): whole hashes of the stretches of `width` shingles within the given ranges (doc_id, low, high) of documents."""
    ranges = store(spots.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    texts = only(docs, ranges.select("doc_id")).join(ranges, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for first, last, data, offsets in text_pieces(batch.column(1)):
                tokens, starts = _sequence(*word_hashes(data, offsets), k)
                lists = batch.column(2).slice(first, last - first)
                row = np.repeat(np.arange(last - first), lists.value_lengths().to_numpy())
                # Places of all rows in one line, with a gap between rows; of texts with one id, the shorter one has fewer.
                low, high = (np.minimum(x.to_numpy(), np.diff(starts)[row]) + starts[row] + row for x in lists.flatten().flatten())
                order = np.argsort(low, kind="stable")
                low, high, row = low[order], high[order], row[order]
                cuts = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])  # ranges that overlap are one
                low, row = low[cuts] - row[cuts], row[cuts]
                n = np.maximum(np.maximum.reduceat(high, cuts) - row - low - width + 1, 0)
                places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                key, owner = stretch_hashes(tokens, width)[places], np.repeat(row, n)
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)]
                ids = batch.column(0).slice(first, last - first).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[owner[new]])], ["key", "doc_id"])
        give_back()

    return texts.select("doc_id", "text", "ranges").mapInArrow(run, "key long, doc_id long")


def uncovered(met: DataFrame, found: DataFrame, k: int, width: int) -> DataFrame:
    """The windows whose stretches of `width` shingles do not all lie inside one passage found in their document."""
    low, high = F.greatest(F.col("place") - F.col("left"), F.col("place") - (width - 1)), F.least(F.col("place") + F.col("right"), F.col("place") + (width - 1))
    spans = store(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    inside = F.exists("spans", lambda s: (s["start"] <= low) & (high <= s["end"] - k))
    return met.join(spans, "doc_id", "left").where(~F.coalesce(inside, F.lit(False)))


def outermost(more: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `more` that lie in no longer passage of their document in either table, and in no equal one with an earlier document."""
    span = F.struct("start", "end", F.col("first_doc_id").alias("first"))
    spans = found.join(more.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(more).groupBy("doc_id").agg(F.collect_set(span).alias("spans"))
    length = F.col("end") - F.col("start")
    holds = lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]) & ((s["end"] - s["start"] > length) | (s["first"] < F.col("first_doc_id")))
    return more.join(spans, "doc_id").where(~F.exists("spans", holds)).select(*more.columns)


def meet(lists: pa.ListArray) -> np.ndarray:
    """For each row's windows (hash, place, left, right) whether those of enough hash functions cover some place together."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    hash_, place, left, right = (x.to_numpy() for x in lists.flatten().flatten())
    base = owner.astype(np.int64) << 32  # Fixed value: places are 32 bits.
    at = np.concatenate([base + (place - left), base + (place + right + 1)])
    order = np.argsort(at, kind="stable")
    at, hash_, step = at[order], np.r_[hash_, hash_][order], np.where(order < len(owner), 1, -1)
    agree = sum((np.cumsum(np.where(hash_ == j, step, 0)) > 0).astype(np.int8) for j in range(HASHES))
    found = np.zeros(len(lists), bool)
    found[at[np.r_[at[1:] != at[:-1], True] & (agree >= ENOUGH)] >> 32] = True
    return found


def compare(first: tuple[np.ndarray, np.ndarray], which: np.ndarray, second: tuple[np.ndarray, np.ndarray], k: int, width: int, least: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(pair, shingle ranges of second and first, similarity) of passages that a pair's second text shares with its first one.

    Both sides are all texts' shingles and where each text's begin; `which` is each pair's first text. The whole texts are
    compared: a minimum may have met another first document elsewhere in a passage of this one.
    """
    (tokens, starts), (mine, own) = first, second
    if not len(tokens) or not len(mine):
        return
    salt = mix64(np.arange(1, len(starts), dtype=np.uint64))  # each first text has keys of its own
    pair = np.repeat(np.arange(len(own) - 1), np.diff(own))
    keys, asked = tokens ^ np.repeat(salt, np.diff(starts)), mine ^ salt[which[pair]]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    same = keys[at] == asked
    where = order[at] - starts[which[pair]]
    edge = np.zeros(len(mine) + 1, bool)  # a text's end parts runs too
    edge[own] = True
    a = np.flatnonzero(same & (edge[:-1] | np.r_[True, ~same[:-1]]))
    b = np.flatnonzero(same & (edge[1:] | np.r_[~same[1:], True])) + 1
    if not len(a):
        return
    # One changed word spoils k shingles: runs that near to each other are one passage with an edit.
    reach = where[a[1:]] - where[b[:-1] - 1]
    near = (pair[a[1:]] == pair[a[:-1]]) & (a[1:] - b[:-1] <= 2 * k) & (reach >= 0) & (reach <= 4 * k)
    low = np.flatnonzero(np.r_[True, ~near])
    high = np.r_[low[1:], len(a)]
    long = b[high - 1] - a[low] >= width
    for x, y in zip(low[long].tolist(), high[long].tolist(), strict=True):
        p = int(pair[a[x]])
        text = tokens[starts[which[p]] : starts[which[p] + 1]]
        group = [*zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)]
        for part in [group] if len(group) == 1 or _alike(text, mine, where, group, least) else [[run] for run in group]:
            c, d = part[0][0], part[-1][1]
            if d - c >= width and (similarity := _alike(text, mine, where, part, least)):
                places = where[c:d][same[c:d]]
                yield p, c - int(own[p]), d - int(own[p]), int(places.min()), int(places.max()) + 1, similarity


def _alike(first: np.ndarray, second: np.ndarray, where: np.ndarray, group: list[tuple[int, int]], least: float) -> float:
    """Similarity of the two stretches' sets if it reaches `least`, else 0."""
    a, b = group[0][0], group[-1][1]
    matched = np.concatenate([where[x:y] for x, y in group])
    if len(group) == 1 and (np.diff(matched) == 1).all():  # the same stretch in both
        return 1.0
    p, q = np.unique(second[a:b]), np.unique(first[matched.min() : matched.max() + 1])
    both = len(np.intersect1d(p, q, assume_unique=True))
    if both >= least * (len(p) + len(q) - both):
        return both / (len(p) + len(q) - both)
    if len(group) == 1:  # an unbroken run, whose shingles stand elsewhere in the first text
        return 1.0
    return 0.0


def verify(pairs: DataFrame, docs: DataFrame, k: int, width: int, least: float) -> DataFrame:
    """Passages of each candidate pair (first, doc_id), from both whole texts."""
    wanted = pairs.select(F.col("first").alias("doc_id")).union(pairs.select("doc_id")).distinct()
    texts = only(docs, store(wanted))
    both = pairs.join(texts, "doc_id").join(texts.withColumnsRenamed({"doc_id": "first", "text": "first_text"}), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                ids, firsts = (part.column(i).to_pylist() for i in range(2))
                ahead = part.column(3).fill_null("").dictionary_encode()  # a first text is cut once for all its pairs
                found = compare(_tokens(ahead.dictionary, k), ahead.indices.to_numpy(), _tokens(part.column(2), k), k, width, least)
                rows += [(ids[p], a, b + k - 1, firsts[p], x, y + k - 1, s) for p, a, b, x, y, s in found]
            columns = [*zip(*rows, strict=True)] or [[]] * len(names)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        give_back()

    return both.select("doc_id", "first", "text", "first_text").mapInArrow(run, FOUND)


def _tokens(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all rows in one line, and where each row's begin (one more at the end)."""
    parts = [_sequence(*word_hashes(data, offsets), k) for _, _, data, offsets in text_pieces(column)]
    counts = np.concatenate([np.diff(starts) for _, starts in parts])
    return np.concatenate([tokens for tokens, _ in parts]), np.concatenate([[0], np.cumsum(counts)])


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Passages of `min_words` or more words that a document shares with one of smaller id.

    Every stretch of `min_words` words that an earlier document holds too lies in one of the rows; of near passages, those
    where ENOUGH hash functions agree with one earlier document that is the first to hold one of these minima, or the first
    to hold two of them in one stretch.

    doc_id, start, end (words, end exclusive), first_doc_id, first_start, first_end, similarity (of the sets of k-word
    shingles). Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. One row for each passage of each document but the
    first that holds it. Null, empty and shorter texts hold none. Rows without an id take no part; repeated rows of one
    id are one document. Other columns are not read; no rows in, no rows out.
    """
    width = min_words - k + 1
    docs = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = store(windows(docs, k, width))
    # Of the joins by key, the smaller side is hashed: sorting all windows costs more than what is kept of them.
    met = store(made.join(first_holders(made).hint("shuffle_hash"), "key").where("doc_id > first"))
    found = store(verify(store(candidate_pairs(met)), docs, k, width, similarity))
    # What met an earlier document and is in no passage yet: that document may lack the passage that later ones share.
    # Near passages: two minima of one stretch have a first document together, which may be the first of neither.
    open_keys = uncovered(met, found, k, width).select("key").distinct()
    both = store(met_minima(made.join(store(open_keys).hint("shuffle_hash"), "key", "left_semi"), width).distinct())
    near = both.join(store(first_holders(both)).hint("shuffle_hash"), "key").where("doc_id > first").select("first", "doc_id").distinct()
    near = near.join(found.select(F.col("first_doc_id").alias("first"), "doc_id").distinct(), ["first", "doc_id"], "left_anti")
    found = store(found.unionByName(outermost(store(verify(store(near), docs, k, width, similarity)), found)))
    one = made.where("hash = 0")  # each stretch is in one window of each hash function
    open_keys = uncovered(met.where("hash = 0"), found, k, width).select("key").distinct()
    holders = one.join(store(open_keys).hint("shuffle_hash"), "key", "left_semi")
    low, high = F.greatest(F.col("place") - F.col("left"), F.col("place") - (width - 1)), F.least(F.col("place") + F.col("right"), F.col("place") + (width - 1))
    hashed = store(stretches(holders.select("doc_id", low.alias("low"), (high + 1).alias("high")), docs, k, width))
    again = hashed.join(store(first_holders(hashed)).hint("shuffle_hash"), "key").where("doc_id > first").select("first", "doc_id").distinct()
    again = again.join(found.select(F.col("first_doc_id").alias("first"), "doc_id").distinct(), ["first", "doc_id"], "left_anti")
    every = found.unionByName(verify(store(again), docs, k, width, similarity))
    order = Window.partitionBy("doc_id", "start", "end", "first_doc_id").orderBy("first_start", "first_end")
    return every.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
