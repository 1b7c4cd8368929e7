"""Helpers that several corpus operators share: storing between jobs, and numpy views of Arrow text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes worked on at once inside a task; a single longer document is still taken whole.
PIECE_BYTES = 1 << 18

#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may go without one: a folder of this machine is no use to executors elsewhere."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def small_batches(df: DataFrame) -> DataFrame:
    """Let the session hand texts to Python in batches of a few MB: the default of 64 MB is held several times over in each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


@lru_cache(maxsize=1)
def lean() -> None:
    """Keep this Python worker small, from its first task on: one arena, and no more than some 32 MB kept for later.

    Workers are reused from stage to stage, and what an allocator keeps in one of them is lost to the others. Lower limits
    cost more than they save: arrays of a few MB would go to the system and come back as new pages all the time.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    if tune := getattr(ctypes.CDLL(None), "mallopt", None):
        # Fixed values of glibc: M_ARENA_MAX, M_MMAP_THRESHOLD, M_TRIM_THRESHOLD.
        for name, value in ((-8, 1), (-3, 16 << 20), (-1, 32 << 20)):
            tune(name, value)


def give_back() -> None:
    """Return memory that this Python worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows of a few numbers that one task should have at least, and tasks that a small table is still dealt to.
TASK_ROWS, LEAST_TASKS = 250_000, 12


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors.

    With `rows`, a bound on the rows of a table without texts, a small one is written by few tasks: many rounds over
    small tables would else spend their time on starting tasks. For large ones this changes nothing.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is among `ids`, without shuffling the texts of the others.

    Spark builds a Bloom filter of bounded size from the ids and applies it to the scan before the semi join; it does so
    by itself only for scans beyond a limit and for a side with a comparison, hence the setting and a comparison that
    holds for every id.
    """
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    return docs.join(ids.where(ids[id_col] >= -(2**63)), id_col, "left_semi")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    # The shifts and multipliers of a public finaliser.
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, bytes, offsets) of consecutive rows of a string column; nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row's end parts words too
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lower-cased, and for each row the index of its first word."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * powers, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct hashes of k consecutive words; all words as one shingle where there are fewer; none without words."""
    n = len(words)
    full = np.zeros(0, np.uint64)
    if n >= k:
        full = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= k:
            yield np.unique(full[low : high - k + 1])
        elif high > low:
            one = np.full(1, high - low, np.uint64)
            for word in words[low:high]:
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + word)
            yield one
        else:
            yield np.zeros(0, np.uint64)
