"""Operator 8: near-duplicate documents by MinHash and an LSH forest.

A document's signature has `TREES * LEVELS` minima. Every tree keeps its own run of them, and documents sorted by a
tree's run share longer prefixes the more alike they are. A region is a group of documents that share a prefix. Its depth
adapts: all regions begin at the depth that the threshold asks for, so that a pair at the threshold shares one in all but
about one case of 50,000, and only regions that stay too large are cut deeper.

1. Documents with the same set of shingles collapse to one representative each.
2. In every region, all members are compared with its most central one (the one whose regions are largest over all
   trees). That is linear in the region and resolves groups of copies, however large.
3. Regions whose members are not yet all in one component compare the members of different components: in one task up to
   `REGION` members. Larger ones first go deeper in their tree, where steps 2 and 3 merge components.
4. The large regions of the first depth that are still mixed are cut into blocks, and all pairs of blocks that hold
   different components are compared, so nothing is left out for its size.
Every link is confirmed on the documents' full sets; links inside a component that is already known add nothing and are
not confirmed again. Texts travel only for pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import connected_components
from tidemark.llm.shared import give_back, lean, mix64, only, shingles, small_batches, store, text_pieces, word_hashes

TREES, LEVELS = 16, 8

#: Members of a region that one task compares with each other, and of two blocks of a larger region.
REGION = 512

#: The largest depth to which large regions are cut to merge components.
DEEPEST = 32

#: Hashes of a bottom sketch: whole sets up to this size, estimates beyond.
BOTTOM = 1024

#: How far an estimate from the signature may lie under the threshold before a pair is not worth confirming: about 6
#: standard deviations of an estimate from 128 minima.
SLACK = 0.22


def first_depth(threshold: float, missed: float = 2e-5) -> int:
    """The largest depth at which a pair at the threshold shares no region in at most the given share of cases."""
    depth = 1
    while (1 - threshold ** (depth + 1)) ** TREES <= missed:
        depth += 1
    return depth


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * TREES * LEVELS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, as 16 bits each of the least 32-bit hash; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * LEVELS), np.uint16)
    for j, (a, b) in enumerate(zip(*_coefficients(), strict=True)):
        out[:, j] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return out


def _runs(minima: np.ndarray) -> np.ndarray:
    """For each tree, the order in which it reads the minima: its own first, then those of the trees after it."""
    return np.stack([np.roll(minima, -t * LEVELS, axis=1)[:, :DEEPEST] for t in range(TREES)], axis=1)


def _prefix_keys(minima: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key of every tree's prefix of the given depth, tree included."""
    runs = _runs(minima)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), runs.shape[:2]).copy()
    for level in range(depth):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + runs[:, :, level].astype(np.uint64))
    return key.view(np.int64)


def prefix_keys(signature: Column, depth: int) -> Column:
    """The 64-bit keys of all trees' prefixes of a signature column, as array<long>."""

    @F.arrow_udf("array<long>")
    def run(column: pa.Array) -> pa.Array:
        minima = np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(len(column), TREES * LEVELS)
        keys = _prefix_keys(minima, depth)
        return pa.ListArray.from_arrays(np.arange(0, keys.size + 1, TREES, dtype=np.int32), keys.ravel())

    return run(signature)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_pieces(column):
        yield from shingles(*word_hashes(data, offsets), k)


def sketches(docs: DataFrame, k: int, depth: int) -> DataFrame:
    """doc_id, n_shingles, and, null for empty sets: a fingerprint of the whole set, its signature, its regions' keys at the first depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                sets = list(_sets(part.column(1), k))
                full = [s for s in sets if len(s)]
                minima = signatures(full) if full else np.zeros((0, TREES * LEVELS), np.uint16)
                made = iter(zip(minima, _prefix_keys(minima, depth), strict=True))
                rows = []
                for s in sets:
                    if len(s):
                        signature, keys = next(made)
                        rows.append((mix64(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(s).tobytes() + len(s).to_bytes(8, "little"), signature.tobytes(), keys))
                    else:
                        rows.append((None, None, None))
                prints, signs, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "signature", "keys"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, signature binary, keys array<long>")


def bottoms(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the least BOTTOM hashes of its set, 32 bits each, in rising order; fewer hashes are the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows = [np.unique((mix64(s) >> np.uint64(32)).astype(np.uint32))[:BOTTOM].tobytes() for s in _sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "bottom"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bottom binary")


def bottom_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by their bottom sketches, over the range of hashes that both sketches have whole."""
    top = min((x[-1] for x in (a, b) if len(x) >= BOTTOM), default=None)
    if top is not None:
        a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents with 100 * |A and B| >= percent * |A or B| on their full sets."""
    texts = docs.select("doc_id", "text")
    one = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    two = one.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                first: dict[int, int] = {}
                for i, x in enumerate(a):
                    first.setdefault(x, i)  # a central document meets many: its set is made once
                left = dict(zip(first, _sets(part.column(2).take(pa.array(list(first.values()), pa.int64())), k), strict=True))
                keep = []
                for x, right in zip(a, _sets(part.column(3), k), strict=True):
                    both = len(np.intersect1d(left[x], right, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(left[x]) + len(right) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class Forest:
    """State of one run: representatives with signatures, and the component that each is known to be in."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int, k: int, percent: int):
        self.docs, self.reps, self.n, self.k, self.percent = docs, reps, n, k, percent
        self.known: DataFrame | None = None  # node, component
        self.signed: DataFrame | None = None  # doc_id, signature, bottom of the documents in regions that stay mixed

    def regions(self, keys: DataFrame) -> DataFrame:
        """(doc_id, key, members) for every region of two members or more, from (doc_id, keys)."""
        n = self.n * TREES
        rows = store(keys.select("doc_id", F.explode("keys").alias("key")), n)
        sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        return store(rows.join(store(sizes, n), "key"), n)

    def with_component(self, rows: DataFrame) -> DataFrame:
        if self.known is None:
            return rows.withColumn("component", F.col("doc_id"))
        known = self.known.withColumnRenamed("node", "doc_id")
        return rows.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def link(self, pairs: DataFrame, bound: int | None = None) -> None:
        """Confirm pairs (`bound` of them at most, if it is known) and join the components of those that hold."""
        pairs = store(pairs.select("a", "b").distinct(), bound)
        n = pairs.count()
        if not n:
            return
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        links = store(confirm(pairs, only(self.docs, store(wanted, 2 * n)), self.k, self.percent))
        n = links.count()
        if self.known is not None:
            if not n:
                return
            for end in ("a", "b"):
                links = self.with_component(links.withColumnRenamed(end, "doc_id")).drop("doc_id").withColumnRenamed("component", end)
        merged = store(connected_components(links, rows=n), 2 * n)
        if self.known is None:
            self.known = merged
            return
        moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
        old = self.known.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        new = merged.join(self.known.select("node"), "node", "left_anti")  # representatives that were alone so far
        self.known = store(old.union(new).distinct(), self.n)

    def stars(self, regions: DataFrame) -> DataFrame:
        """Pairs of each region's most central member and the others not yet in its component."""
        weight = regions.groupBy("doc_id").agg(F.sum("members").alias("weight"))
        weighed = regions.join(store(weight, self.n), "doc_id")
        centre = weighed.groupBy("key").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("centre"))
        pairs = regions.join(store(centre, self.n * TREES), "key").where("doc_id != centre")
        if self.known is None:
            return pairs.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
        pairs = self.with_component(pairs.select("centre", "doc_id").distinct()).withColumnsRenamed({"doc_id": "b", "component": "of_b"})
        pairs = self.with_component(pairs.withColumnRenamed("centre", "doc_id")).withColumnRenamed("doc_id", "a")
        return pairs.where("component != of_b").select("a", "b")

    def mixed(self, regions: DataFrame) -> DataFrame:
        """The regions whose members are in more than one component, with each member's component."""
        rows = self.with_component(regions)
        many = rows.groupBy("key").agg((F.min("component") != F.max("component")).alias("many")).where("many").select("key")
        return store(rows.join(store(many, self.n * TREES), "key"), self.n * TREES)

    def compare(self, rows: DataFrame, floor: float) -> DataFrame:
        """Pairs of different components that neither signatures nor bottom sketches rule out, within groups of at most two blocks."""
        if self.signed is None:  # deeper regions hold no other documents
            wanted = store(rows.select("doc_id").distinct(), self.n)
            bottom = bottoms(only(self.docs, wanted), self.k).groupBy("doc_id").agg(F.min("bottom").alias("bottom"))
            self.signed = store(only(self.reps, wanted).join(bottom, "doc_id"))
        signed = rows.where(F.col("members") <= REGION).join(self.signed, "doc_id")
        percent = self.percent

        def run(table: pa.Table) -> pa.Table:
            lean()
            table = table.sort_by("doc_id")
            ids, group, side = (table.column(c).to_numpy() for c in ("doc_id", "component", "side"))
            minima = np.frombuffer(b"".join(x.as_py() for x in table.column("signature")), np.uint16).reshape(len(ids), -1)
            low = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("bottom")]
            a, b = [], []
            for i in range(len(ids) - 1):
                other = np.flatnonzero((group[i + 1 :] != group[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0))) + i + 1
                near = other[(minima[other] == minima[i]).sum(1) >= floor * minima.shape[1]]
                for j in near:
                    slack = 0.08 if max(len(low[i]), len(low[j])) >= BOTTOM else 0.01  # estimates: 6 standard deviations; whole sets: colliding hashes
                    if bottom_similarity(low[i], low[j]) >= percent / 100 - slack:
                        a.append(ids[i])
                        b.append(ids[j])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return signed.groupBy("key", "block").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, shingles k consecutive words (all of them, where there are
    fewer). Documents whose sets' similarity is at least percent / 100 are linked; component_id is the smallest doc_id
    that links reach and kept says whether that is the document's own. Null and empty texts have an empty set and stand
    alone. Rows without an id get a null component and are kept. Rows that repeat an id are one document, which has the
    links of each of its texts; each row is answered, with its own n_shingles. Other columns are not read; no rows in, no
    rows out.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = store(sketches(docs, k, first_depth(percent / 100)))
    several = made.where("doc_id is not null").groupBy("doc_id").agg((F.min(F.xxhash64("print")) != F.max(F.xxhash64("print"))).alias("several"))
    if several.where("several").limit(1).count():
        return _by_row(docs, k, percent)
    return _placed(docs, made, k, percent)


def _by_row(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """`near_duplicates` where an id has different texts: every row is a document of its own, and then all rows of an id are joined."""
    numbered = store(docs.withColumn("row", F.monotonically_increasing_id()))
    rows = numbered.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
    found = _placed(rows, store(sketches(rows, k, first_depth(percent / 100))), k, percent)
    found = store(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group")).join(numbered.select("row", "doc_id"), "row"))
    least = store(found.groupBy("group").agg(F.min("doc_id").alias("least")))
    tops = connected_components(found.select("doc_id", "group").distinct().join(least, "group"), "doc_id", "least")
    own = F.coalesce("component", "doc_id")
    placed = found.join(store(tops).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
    nameless = sketches(numbered.where("doc_id is null"), k, 1).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return placed.unionByName(nameless)


def _placed(docs: DataFrame, made: DataFrame, k: int, percent: int) -> DataFrame:
    """`near_duplicates` where all rows of an id have the same set; `made` has their sketches."""
    floor = percent / 100 - SLACK
    depth = first_depth(percent / 100)
    full = made.where("doc_id is not null and n_shingles > 0")
    if full.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows of one id with the same set: one of them speaks for all
        full = store(full.groupBy("doc_id").agg(F.min_by(F.struct("print", "signature", "keys"), "print").alias("row")).select("doc_id", "row.*"))
    # Same set, same component: the smallest id stands for all. Signatures stay where they are until a region needs them.
    n = full.count()
    shared = store(full.groupBy("print").agg(F.min("doc_id").alias("rep")), n)
    chosen = shared.select(F.col("rep").alias("doc_id"))
    reps = full.select("doc_id", "signature")
    forest = Forest(docs, reps, n, k, percent)
    regions = forest.regions(full.select("doc_id", "keys").join(chosen, "doc_id", "left_semi"))
    whole = None  # the large regions of the first depth
    while True:
        # Small regions are compared in whole below; the first round spares them most of that.
        central = regions if forest.known is None else regions.where(F.col("members") > REGION)
        forest.link(forest.stars(central), n * TREES)
        rows = forest.mixed(regions)
        every = rows.select("key", "doc_id", "component", "members", F.lit(0).alias("block"), F.lit(-1).alias("side"))
        forest.link(forest.compare(every, floor))
        large = rows.where(F.col("members") > REGION)
        if not large.limit(1).count():
            break
        whole = large if whole is None else whole
        if depth >= DEEPEST:
            break
        depth = min(3 * depth, DEEPEST)
        deeper = reps.join(store(large.select("doc_id").distinct(), n), "doc_id", "left_semi")
        regions = forest.regions(deeper.select("doc_id", prefix_keys(F.col("signature"), depth).alias("keys")))
    if whole is not None:  # members that parted on the way down meet here
        forest.link(forest.compare(_blocks(forest.mixed(whole.drop("component"))), floor))
    tops = shared.select("print", F.col("rep").alias("top"))
    if forest.known is not None:
        known = forest.known.withColumnsRenamed({"node": "top", "component": "of_top"})
        tops = tops.join(known, "top", "left").select("print", F.coalesce("of_top", "top").alias("top"))
    placed = made.select("doc_id", "n_shingles", "print").join(store(tops, n), "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Members dealt to blocks of a region, and each block to every pair of blocks that it is in; `side` tells the two apart.

    A component larger than a block has blocks of its own, which are not paired with each other; the rest share theirs.
    """
    half = REGION // 2
    count = lambda c: F.ceil(F.col(c) / half).cast("long")
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("part"))
    parts = parts.withColumn("pool", F.when(F.col("part") > half, F.col("component"))).groupBy("key", "pool").agg(F.sum("part").alias("part"))
    by_pool = Window.partitionBy("key").orderBy(F.col("pool").asc_nulls_first())
    parts = parts.withColumn("mine", count("part")).withColumn("upto", F.sum("mine").over(by_pool)).withColumn("n", F.sum("mine").over(Window.partitionBy("key")))
    parts = store(parts.select("key", "pool", "mine", "n", (F.col("upto") - F.col("mine")).alias("low")))
    single = rows.join(parts.where("pool is not null").withColumnRenamed("pool", "component"), ["key", "component"])
    shared = rows.join(parts.where("pool is null").drop("pool"), "key")
    shared = shared.join(parts.where("pool is not null").select("key", F.col("pool").alias("component")), ["key", "component"], "left_anti")
    others = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    dealt = single.withColumn("other", F.explode(F.filter(others, lambda x: (x < F.col("low")) | (x >= F.col("low") + F.col("mine")))))
    dealt = dealt.unionByName(shared.withColumn("other", F.explode(others)))
    dealt = dealt.withColumn("own", F.col("low") + F.pmod(F.xxhash64("doc_id"), F.col("mine")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return dealt.select("key", "doc_id", "component", F.lit(REGION).alias("members"), (low * F.col("n") + high).alias("block"), side.alias("side"))


def expected_misses(similarity: float, threshold: float) -> float:
    """The share of pairs of a similarity that meet in no region of the first depth."""
    return float(np.exp(TREES * log(1 - similarity ** first_depth(threshold)))) if similarity < 1 else 0.0
