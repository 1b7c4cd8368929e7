"""Token ids of many words at once: the merges of all words of a batch are done side by side in numpy.

A stretch of text without white space gives the same ids wherever it stands. So each task keeps the ids of the stretches
it has met, bounded by bytes; those of a batch that are new are cut into pre-tokens and fragments by the encoder of
`bpe`, and all fragments are merged together, one merge of each fragment a step.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.bpe import ForcedBoundaryBpe, encoder
from tidemark.llm.shared import give_back, lean, small_batches

#: Bytes of stretches and their ids that a task keeps where not told otherwise, and what an entry takes besides its letters and ids, about.
KEPT_BYTES, ENTRY_BYTES = 16 << 20, 150

#: Bytes of text that are encoded at once; a longer text is taken whole.
CHUNK_BYTES = 1 << 18

#: Longer fragments are merged one by one.
TABLED = 64

_SLOTS = 18

_DIGIT = 1
_KINDS = np.array([0 if 0x61 <= b <= 0x7A else _DIGIT if 0x30 <= b <= 0x39 else 2 for b in range(256)], np.uint8)  # of lower-case ASCII


class BatchBpe:
    """Ids as bytes (little-endian, 32 bits each) of whole texts, for one vocabulary file."""

    def __init__(self, bpe: ForcedBoundaryBpe, kept_bytes: int = KEPT_BYTES):
        self.bpe = bpe
        self.ids = {t: i for i, t in bpe.tokens.items()}
        pairs = sorted(bpe.ranks.items(), key=lambda x: x[1])
        left = np.array([self.ids[a] for (a, _), _ in pairs], np.uint64)
        right = np.array([self.ids[b] for (_, b), _ in pairs], np.uint64)
        self.into = np.array([self.ids[t] for t in bpe.joined], np.int32)
        self.keys = np.full(1 << _SLOTS, -1, np.int64)
        self.rank = np.full(1 << _SLOTS, len(pairs), np.int32)
        for key, rank, slot in zip(*(x.tolist() for x in ((left << np.uint64(32) | right).astype(np.int64), np.arange(len(pairs)), self._slots(left, right))), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOTS) - 1)
            self.keys[slot], self.rank[slot] = key, rank
        self.none = len(pairs)
        self.letter = np.array([self.ids.get(x, 0) for x in bpe.letters], np.int32)
        self.last = np.array([self.ids.get(x + bpe.end, 0) for x in bpe.letters], np.int32)
        self.byte = {x: b for b, x in enumerate(bpe.letters)}
        self.inner = np.zeros((256, 256), bool)
        for a, b in bpe.inner:
            if a in self.byte and b in self.byte:
                self.inner[self.byte[a], self.byte[b]] = True
        self.tokens = [bpe.tokens.get(i, "") for i in range(max(bpe.tokens) + 1)]
        self.numbers = list(map(str, range(len(self.tokens))))
        self.kept: dict[str, bytes] = {}
        self.room = self.limit = kept_bytes

    @staticmethod
    def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # Fixed value: a multiplier of multiplicative hashing.
        return (((left * np.uint64(65_537) + right) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; `none` where there is none."""
        a, b = left.astype(np.uint64), right.astype(np.uint64)
        key, slot = (a << np.uint64(32) | b).astype(np.int64), self._slots(a, b)
        there = self.keys[slot]
        out = np.where(there == key, self.rank[slot], self.none).astype(np.int32)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOTS) - 1)
            there = self.keys[slot[open_]]
            out[open_] = np.where(there == key[open_], self.rank[slot[open_]], self.none)
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return out

    def merge(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each fragment's tokens until no pair has a rank: always its best-ranked pair, the leftmost of equals.

        Returns the tokens of all fragments in their order and where each begins (one more at the end).
        """
        n, sizes = len(tokens), np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_tokens, done_owner = [], []
        rank = np.full(n, self.none, np.int32)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self._ranks(tokens[:-1][same], tokens[1:][same])
        while len(tokens):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            over = best == self.none
            if over.any():
                ended = np.repeat(over, np.diff(np.r_[first, len(tokens)]))
                done_tokens.append(tokens[ended])
                done_owner.append(owner[ended])
                tokens, owner, rank = tokens[~ended], owner[~ended], rank[~ended]
                if not len(tokens):
                    break
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                best = best[~over]
            spread = np.repeat(best, np.diff(np.r_[first, len(tokens)]))
            hit = np.flatnonzero(rank == spread)
            at = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]  # the leftmost of each fragment
            tokens[at] = self.into[best]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            # Pairs change where the new token is the left or the right one.
            moved = np.cumsum(keep) - 1
            tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
            for place in (moved[at], moved[at] - 1):
                place = place[place >= 0]
                inside = (place + 1 < len(tokens)) & (owner[np.minimum(place + 1, len(tokens) - 1)] == owner[place])
                rank[place[~inside]] = self.none
                place = place[inside]
                rank[place] = self._ranks(tokens[place], tokens[place + 1])
        owner, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_owner, done_tokens))
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))

    def _new(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches without white space, each once."""
        # ASCII without apostrophes parts where the kind of character changes, and around each digit; the rest by patterns.
        plain = [s for s in stretches if s.isascii() and "'" not in s]
        rest = [s for s in stretches if not s.isascii() or "'" in s]
        runs: list[bytes] = []
        sizes = list(map(len, plain))
        for s in rest:
            parts = [p.encode() for p in (self.bpe._plain if s.isascii() else self.bpe._parts).findall(s)]
            runs += parts
            sizes.append(sum(map(len, parts)))
        head = np.frombuffer("".join(plain).encode(), np.uint8)
        data = np.concatenate([head, np.frombuffer(b"".join(runs), np.uint8)])
        if not len(data):
            return dict.fromkeys(stretches, b"")
        edges = np.r_[0, np.cumsum(sizes)]
        kind = _KINDS[head]
        start = np.zeros(len(data) + 1, bool)
        start[1 : len(head)] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start[edges] = True
        start[len(head) + np.fromiter(accumulate(map(len, runs)), np.int64, len(runs))] = True
        ends = np.flatnonzero(start)[1:]
        start[1:-1] |= ~self.inner[data[:-1], data[1:]]  # forced boundaries
        starts = np.flatnonzero(start)
        tokens = self.letter[data]
        tokens[ends - 1] = self.last[data[ends - 1]]
        merged, begin = self._merge_all(tokens, starts, data, ends, np.flatnonzero(np.diff(starts) > TABLED))
        packed = merged.astype("<u4").tobytes()
        # A stretch's ids are those of its fragments.
        at = (begin[np.searchsorted(starts, edges)] * 4).tolist()
        return {s: packed[x:y] for s, x, y in zip(plain + rest, at[:-1], at[1:], strict=True)}

    def _merge_all(self, tokens: np.ndarray, starts: np.ndarray, data: np.ndarray, ends: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merge`, with long fragments merged one by one by the encoder of `bpe`."""
        if not len(long):
            return self.merge(tokens, starts)
        letters, closing = self.bpe.letters, set(ends.tolist())
        sizes = np.diff(starts)
        short = np.repeat(sizes <= TABLED, sizes)
        part, begin = self.merge(tokens[short], np.r_[0, np.cumsum(np.where(sizes <= TABLED, sizes, 0))])
        pieces = []
        low = 0
        for i in long.tolist():
            pieces.append(part[begin[low] : begin[i]])
            text = "".join(letters[b] for b in data[starts[i] : starts[i + 1]].tolist())
            pieces.append(np.array([self.ids[t] for t in self.bpe._merge(text, int(starts[i + 1]) in closing)], np.int32))
            low = i + 1
        pieces.append(part[begin[low] :])
        counts = np.diff(begin)
        counts[long] = [len(x) for x in pieces[1::2]]
        return np.concatenate(pieces), np.r_[0, np.cumsum(counts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        bpe = self.bpe
        split, marks = bpe._split_special, list(bpe.special)
        words: list[list[str]] = []
        special: list[tuple[int, int, str]] = []
        for k, text in enumerate(texts):
            if split and any(m in text for m in marks):
                found: list[str] = []
                for j, part in enumerate(split.split(text)):
                    if j % 2:
                        special.append((k, len(found), part))
                        found.append("")
                    else:
                        found += bpe._stretches(part)
                words.append(found)
            else:
                words.append(bpe._stretches(text))
        kept = self.kept
        new = list(set().union(*words).difference(kept))
        if new:
            made = self._new(new)
            size = _size(made)
            if size > self.room:  # what this chunk needs is all that stays
                kept = self.kept = {w: kept[w] for w in set().union(*words) if w in kept}
                self.room = self.limit - _size(kept)
            kept.update(made)
            self.room -= size
        out = [list(map(kept.__getitem__, found)) for found in words]
        for k, j, mark in special:
            out[k][j] = bpe.special[mark].to_bytes(4, "little")
        return list(map(b"".join, out))

    def both(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids as decimal numbers, and the decoded text of each text.

        The vocabulary has no decoder of its own, so tokens are joined by single spaces, as ids are.
        """
        for packed in self.encode(texts):
            ids = np.frombuffer(packed, "<u4").tolist()
            yield len(ids), " ".join(map(self.numbers.__getitem__, ids)), " ".join(map(self.tokens.__getitem__, ids))


def _size(made: dict[str, bytes]) -> int:
    return sum(map(len, made)) + sum(map(len, made.values())) + ENTRY_BYTES * len(made)


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of consecutive rows of a string column, some CHUNK_BYTES at a time; nulls count as empty."""
    first, texts, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py() or ""
        if texts and size + len(text) > CHUNK_BYTES:
            yield first, texts
            first, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


@lru_cache(maxsize=1)
def batch_encoder(path: str, kept_bytes: int = KEPT_BYTES) -> BatchBpe:
    """The encoder of a Python worker, for the vocabulary file it was last asked for."""
    made = BatchBpe(encoder(path), kept_bytes)
    gc.collect()
    gc.freeze()
    give_back()
    return made


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def bpe_encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: `id_col`, ids array<int>, decoded string. Null texts count as empty: no ids, empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bpe = batch_encoder(vocab)
        for batch in batches:
            for low, texts in chunks(batch.column(1)):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)]
                decoded = [bpe.bpe.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, vocab: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text.

    Null and empty texts give no tokens and the digest of the empty string. Repeated rows are each answered. Only
    doc_id and text are read, so other columns may have any name. No rows in, no rows out. The text is encoded and
    decoded in one pass and never leaves its task, so there is no shuffle at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bpe = batch_encoder(vocab)
        for batch in batches:
            rows = []
            for n, ids, decoded in (x for _, texts in chunks(batch.column(1)) for x in bpe.both(texts)):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            columns = [*zip(*rows, strict=True)] if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], RESULT.names)
        give_back()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, RESULT)
