"""Operator 12: vector best-fit packing of documents into sequences.

A piece of a document takes three things of a sequence: its tokens, one place for a document, and the square of its
tokens as attention cost. All three follow from its length, so pieces of one length are alike, and the packing of any
number of pieces is the packing of at most 4,096 kinds with a count each. Kinds come longest first. Open sequences with
the same residual capacities are alike too and are kept as one class with a count. Each step fills the class that fits
best under every constraint, as one piece at a time would, but for all its sequences at once.

The plan that comes out grows with the number of classes, which the capacities bound, and not with the documents. The
pieces are numbered within their length by a range sort, and the number finds a piece's place in the plan.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_batch import batch_encoder, chunks
from tidemark.operators.ranges import ranked
from tidemark.llm.shared import give_back, lean, small_batches, store

#: Bytes of words and their ids that a task keeps.
KEPT_BYTES = 64 << 20


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and the sum of squared lengths; and what a unit of each residual weighs in the choice."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)

    def needs(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    @property
    def whole(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)

    @property
    def longest(self) -> int:
        """The longest piece that a sequence of its own can hold."""
        return min(self.tokens, math.isqrt(self.attention))


def fits(left: np.ndarray, need: np.ndarray, capacity: Capacity, by: str) -> np.ndarray:
    """For each row of residual capacities, how badly a piece fits: infinite where any capacity is short.

    "dot": the weighted dot product of residuals and needs, as shares of the capacities. It is the least where what the
    piece needs most is nearly used up: a tight fit. "norm": the weighted norm of what would be left.
    """
    whole = capacity.whole
    if by == "dot":
        badness = (left / whole) @ (np.array(capacity.weights) * need / whole)
    else:
        badness = np.sqrt((((left - need) / whole) ** 2) @ np.array(capacity.weights))
    return np.where((left >= need).all(1), badness, np.inf)


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), by: str = "dot") -> np.ndarray:
    """Where the pieces of each length go. `counts`: how many pieces of each length there are; none is above capacity.longest.

    Rows (length, first, sequence, each, offset), by length and first: from the piece `first` of its length on, `each`
    pieces after another go to each of the sequences from `sequence` on, the first of them to place `offset`.
    """
    left = np.tile(capacity.whole, (1024, 1))
    many = np.zeros(1024, np.int64)  # sequences of each class
    before = [-1] * 1024  # the class that a class came from, and the pieces it got since
    got = [(0, 0)] * 1024
    n = 0

    def open_class(residual: np.ndarray, count: int, parent: int, pieces: tuple[int, int]) -> None:
        nonlocal left, many, n
        if n == len(many):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
            before.extend([-1] * n)
            got.extend([(0, 0)] * n)
        left[n], many[n], before[n], got[n] = residual, count, parent, pieces
        n += 1

    for length in sorted(counts, reverse=True):
        need, rest = capacity.needs(length), counts[length]
        live = np.flatnonzero((many[:n] > 0) & (left[:n] >= need).all(1))
        # A piece makes its sequence fit worse for none but those it no longer fits, so one order holds for all pieces of a length.
        for c in live[np.argsort(fits(left[live], need, capacity, by), kind="stable")].tolist() if len(live) else []:
            if not rest:
                break
            rest = _fill(c, length, need, rest, left, many, open_class)
        if rest:
            c = n
            most = int((capacity.whole // need).min())
            open_class(capacity.whole, -(-rest // most), -1, (0, 0))
            _fill(c, length, need, rest, left, many, open_class)

    next_of: dict[int, int] = {}
    rows, sequence = [], 0
    for c in np.flatnonzero(many[:n]).tolist():
        path, at = [], c
        while at >= 0:
            path.append(got[at])
            at = before[at]
        offset = 0
        for length, each in reversed(path):
            if each:
                first = next_of.get(length, 0)
                rows.append((length, first, sequence, each, offset))
                next_of[length] = first + each * int(many[c])
                offset += length * each
        sequence += int(many[c])
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _fill(c: int, length: int, need: np.ndarray, rest: int, left: np.ndarray, many: np.ndarray, open_class) -> int:
    """Give the class's sequences as many pieces as they hold, one sequence after another; the pieces that remain."""
    residual, there = left[c].copy(), int(many[c])
    each = int((residual // need).min())
    full = min(there, rest // each)
    part = rest - full * each if full < there else 0
    many[c] = there - full - (part > 0)
    if full:
        open_class(residual - each * need, full, c, (length, each))
    if part:
        open_class(residual - part * need, 1, c, (length, part))
    return rest - full * each - part


def pieces(docs: DataFrame, vocab: str, capacity: Capacity = Capacity(), end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its id as doc_id, piece, start, length, ids_crc32, and ids binary if asked for.

    A document is its text's tokens and `end`. Only one longer than a sequence is cut, at multiples of what one holds. A
    null text is an empty one: one piece of one token. `ids` are little-endian and of 32 bits.
    """
    size = 4 * capacity.longest
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bpe, closing = batch_encoder(vocab, KEPT_BYTES), end.to_bytes(4, "little")
        for batch in batches:
            for low, texts in chunks(batch.column(1)):
                of, rows = [], []
                for k, ids in enumerate(bpe.encode(texts), low):
                    ids += closing
                    for i, at in enumerate(range(0, len(ids), size)):
                        cut = ids[at : at + size]
                        of.append(k)
                        rows.append((i, at // 4, len(cut) // 4, zlib.crc32(cut), *[cut] * with_ids))
                columns = [*zip(*rows, strict=True)] if rows else [[]] * (len(names) - 1)
                kinds = [pa.int32(), *[pa.int64()] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, kinds))], names)
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def place_pieces(cut: DataFrame, capacity: Capacity = Capacity(), by: str = "dot") -> DataFrame:
    """The stored table of pieces with sequence_id and offset added: no sequence passes any capacity, and offsets leave no gaps.

    No rows in, no rows out. Columns other than `length` are carried along. Repeated rows are pieces of their own. The
    histogram of lengths is all that the driver sees, and the plan (5 numbers a row, a row for each length in each class
    of sequences) is all that is sent to tasks; both are bounded by the capacities, whatever the number of pieces.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    if not counts:
        return cut.select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"))
    context = cut.sparkSession.sparkContext
    total = sum(counts.values())
    shorter = np.zeros(max(counts) + 1, np.int64)  # for each length, the pieces that are shorter
    shorter[list(counts)] = list(counts.values())
    shorter = np.cumsum(shorter) - shorter
    sent = context.broadcast((plan(counts, capacity, by), shorter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, shorter = sent.value
        # Rows are in the order of (length, first): one search finds a piece's row.
        wide = np.int64(total + 1)
        keys = steps[:, 0] * wide + steps[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            nth = batch.column("place").to_numpy(zero_copy_only=False) - 1 - shorter[length]
            row = steps[np.searchsorted(keys, length * wide + nth, "right") - 1]
            further = nth - row[:, 1]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + further // row[:, 3]), pa.array(row[:, 4] + further % row[:, 3] * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = ranked(cut.withColumn("row", F.monotonically_increasing_id()), F.col("length"), F.col("row")).drop("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocab: str, capacity: Capacity = Capacity(), by: str = "dot") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of one token. Repeated rows are documents of their own and may share a sequence.
    A null id stays null. Only doc_id and text are read, so other columns may have any name. No rows in, no rows out.
    """
    return place_pieces(store(pieces(docs, vocab, capacity)), capacity, by)


def packed_sequences(docs: DataFrame, vocab: str, capacity: Capacity = Capacity(), by: str = "dot") -> DataFrame:
    """The sequences themselves, for training: sequence_id, ids array<int>, doc_ids, and `edges`: where each piece begins.

    A sequence's pieces meet by its number; there are never more than its capacities allow.
    """
    placed = place_pieces(store(pieces(docs, vocab, capacity, with_ids=True)), capacity, by)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1), batch.column(3)], ["sequence_id", "ids", "doc_ids", "edges"])

    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    held = placed.groupBy("sequence_id").agg(row.alias("held")).select("sequence_id", "held.doc_id", "held.ids", "held.offset")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(join, f"sequence_id bigint, ids array<int>, doc_ids array<{kind}>, edges array<bigint>")
