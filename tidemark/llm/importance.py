"""Operator 11: importance resampling of documents towards a target distribution of hashed word features.

Two passes of Arrow batches. The first counts the hashed features of each task's texts with np.bincount; the tasks'
vectors of 10,000 numbers are merged by treeReduce. The second gathers the gain of each feature's bucket from a broadcast
vector and sums the gains of a document with np.bincount's weights. Documents are then drawn by their weight with Gumbel
noise: the k highest scores are a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranges import ranked
from tidemark.llm.shared import give_back, lean, small_batches, store, text_pieces
from tidemark.llm.terms import term_bounds

BUCKETS = 10_000

#: Longer terms are hashed one by one.
TABLED = 64

#: Vectors that one step of the merge adds up.
FAN_IN = 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32's table of bytes, and for n = 0..TABLED what n more zero bytes make of each byte of a checksum, flat."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)  # fixed value: the polynomial
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
    moved = [state]
    for _ in range(TABLED):
        state = step[state & 255] ^ (state >> 8)
        moved.append(state)
    return step, np.stack(moved).ravel()


def _after(crc: np.ndarray, zeros: np.ndarray | int) -> np.ndarray:
    """Checksums carried over as many zero bytes."""
    moved, base = _tables()[1], np.asarray(zeros, np.int64) * 1024
    out = moved[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= moved[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes: all stretches byte by byte, those that have ended drop out."""
    step, order = _tables()[0], np.argsort(-lengths, kind="stable")
    at, sizes = starts[order], lengths[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-sizes, -TABLED, "left"))
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        live = slice(long, int(np.searchsorted(-sizes, -k, "left")))
        crc[live] = step[(crc[live] ^ data[at[live] + k]) & 255] ^ (crc[live] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of texts: each feature's bucket and row, and each row's number of words."""
    data, starts, ends, first = term_bounds(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    lengths = ends - starts
    one = _checksums(data, starts, lengths)
    pair = np.flatnonzero(row[1:] == row[:-1])
    left, size, crc = _after(one[pair], 1) ^ np.uint32(zlib.crc32(b" ")), lengths[pair + 1], one[pair + 1]
    two = _after(left, np.minimum(size, TABLED)) ^ crc
    for i in np.flatnonzero(size > TABLED):
        begin = starts[pair[i] + 1]
        two[i] = zlib.crc32(data[begin : begin + size[i]], int(left[i]))
    return np.r_[one, two] % np.uint32(BUCKETS), np.r_[row, row[pair]], words


def feature_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Null texts have none; an empty table gives zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets)[0], minlength=BUCKETS)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    context = texts.sparkSession.sparkContext
    vectors = small_batches(texts).select(text_col).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    vectors = context.union([vectors, context.parallelize([np.zeros(BUCKETS, np.int64)], 1)])
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions(), FAN_IN)))
    return vectors.treeReduce(np.add, depth)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a feature of each bucket is in the target, with one feature more in every bucket; floored."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratios = [float((int(t) + 1) * s_all) / float((int(s) + 1) * t_all) for s, t in zip(source, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def document_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id as doc_id, n_words, n_features, weight (the floored mean of its features' gains; 0 without features)."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for low, high, data, offsets in text_pieces(batch.column(1)):
                buckets, row, words = feature_buckets(data, offsets)
                features = np.bincount(row, minlength=high - low)
                sums = np.bincount(row, sent.value[buckets], minlength=high - low)  # whole numbers below 2**53: exact
                weight = np.rint(sums).astype(np.int64) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank (1.. in the draw's order; null where not drawn).

    Null and empty texts have no features and weight 0; they are scored, and never drawn, like all with fewer than
    `least_words` words. Repeated rows are documents of their own: each is scored, counted and drawn (with one id they
    have one score, and either may come first). A null id is hashed as an empty one and comes before others at ties. Only
    doc_id and the texts are read, so other columns may have any name. No rows in, no rows out; an empty target gives
    every bucket the gain of its rarity alone.
    """
    gains = bucket_gains(feature_counts(docs), feature_counts(target))
    # Fixed value: 4294967296, the number of hashes.
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = document_weights(docs, gains).withColumn("score", F.col("weight") + noise)
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    # Scores are whole numbers between bounds that the data don't move: their histogram is short.
    upto = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = able.groupBy("score").count().select("score", F.sum("count").over(upto).alias("upto"))
    drawn = able.count() * percent // 100
    cut = steps.where(F.col("upto") >= drawn).orderBy(F.col("score").desc()).first() if drawn else None
    kept = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*kept, F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= least_words) & (F.col("score") >= cut["score"])
    first = ranked(scored.where(near), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row"))
    return first.select(*kept, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(scored.where(~near).select(*kept, F.lit(None).cast("long").alias("rank")))


RESAMPLE_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i::BIGINT, 1::BIGINT, 2::BIGINT, 3::BIGINT, 4::BIGINT, 5::BIGINT, 6::BIGINT, 7::BIGINT, 8::BIGINT],
                          lambda c, k: xor(c >> 1::BIGINT, (c & 1::BIGINT) * 3988292384::BIGINT)) ORDER BY i) AS steps
  FROM range(256) t(i)),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, text, true AS source FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
parted AS (
  SELECT row, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts),
features AS (
  SELECT row, source, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
  FROM parted),
counted AS (SELECT row, source, feature, count(*)::BIGINT AS times FROM features GROUP BY ALL),
hashed AS (
  SELECT feature, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(hex(encode(feature))), 2), lambda i: ('0x' || substr(hex(encode(feature)), (i + 1)::BIGINT, 2))::BIGINT)),
           lambda c, b: xor(c >> 8::BIGINT, steps[(xor(c, b) & 255::BIGINT) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc_table),
buckets AS (
  SELECT bucket, coalesce(sum(times) FILTER (source), 0)::BIGINT AS s, coalesce(sum(times) FILTER (NOT source), 0)::BIGINT AS t
  FROM counted JOIN hashed USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM buckets),
weighed AS (
  SELECT row, sum(times)::BIGINT AS n_features, floor(sum(times * gain)::DOUBLE / sum(times)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE source GROUP BY row),
scored AS (
  SELECT doc_id, row, coalesce(len(words), 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts JOIN parted USING (row, source) LEFT JOIN weighed USING (row) WHERE source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, row) AS place,
         count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
