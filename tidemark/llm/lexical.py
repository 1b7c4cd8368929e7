"""Operator 13: ranked lexical search over term-bucketed postings.

The index is a DataFrame of buckets: one row for each term and shard of documents, with the term's postings there. A
shard's size is bounded, so a term that every document holds has many buckets of a bounded size and none is hot. The
items' terms are joined to the buckets; each posting's part of a score is computed once, in integers; the parts are
dealt by document, meet the items that ask for the term, and are summed by item and document; a window takes each
item's best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import give_back, lean, small_batches, store
from tidemark.llm.terms import terms

#: Documents and bytes of text in a shard; a longer document is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20

#: Item terms that are sent to every task: beyond that many rows or bytes they are joined by shuffles.
SENT_ROWS, SENT_BYTES = 1 << 20, 32 << 20

#: The scale of a term's weight, and the share of a document's length in its part, in hundredths.
SCALE, LENGTH_SHARE = 1000, 75


def postings(docs: DataFrame, only: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The buckets: term, and arrays doc_id, row, tf, n with a place for each document of the shard that holds the term.

    `row` numbers the documents, so that rows with one id stay apart; n is the document's number of terms. Each shard
    also has a row without a term that holds shard_docs and shard_terms: its documents with a term, and all their terms.
    With `only`, postings of other terms are left out (n and the shards' rows count all terms).
    """

    def bucketed(held: list) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        which: list[int] = []
        tfs: list[int] = []
        ids, sizes, counts, rows = [], [], [], []
        for row, doc_id, words in held:
            tf = Counter(words)
            found = tf.keys() if only is None else tf.keys() & only
            which += [number.setdefault(t, len(number)) for t in found]
            tfs += map(tf.__getitem__, found)
            ids.append(doc_id)
            rows.append(row)
            sizes.append(len(words))
            counts.append(len(found))
        key = np.array(which, np.int64)
        order = np.argsort(key, kind="stable")
        place = np.repeat(np.arange(len(held)), counts)[order]
        # The last bucket is the shard's own row: without postings.
        ends = np.r_[0, np.cumsum(np.bincount(key, minlength=len(number))), len(key)].astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
        null = [None] * len(number)
        return pa.RecordBatch.from_arrays([
            pa.array([*number, None], pa.binary()).cast(pa.string()),
            lists(pa.array(ids, held_type[0]).take(pa.array(place))),
            lists(pa.array(np.array(rows, np.int64)[place])),
            lists(pa.array(np.array(tfs, np.int32)[order])),
            lists(pa.array(np.array(sizes, np.int32)[place])),
            pa.array([*null, sum(s > 0 for s in sizes)], pa.int64()),
            pa.array([*null, sum(sizes)], pa.int64()),
        ], ["term", "doc_id", "row", "tf", "n", "shard_docs", "shard_terms"])

    held_type: list[pa.DataType] = [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        row, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held_type[0] = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if held and (len(held) >= SHARD_DOCS or size + len(text or b"") > SHARD_BYTES):
                    yield bucketed(held)
                    held, size = [], 0
                held.append((row, doc_id, terms(text)))
                size += len(text or b"")
                row += 1
        if held:
            yield bucketed(held)
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"term string, doc_id array<{kind}>, row array<bigint>, tf array<int>, n array<int>, shard_docs bigint, shard_terms bigint"
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each item and term: item (a number of its own for each row of `items`), item_id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                rows += [(item, k, t, n) for t, n in Counter(terms(text.as_py())).items()]
                item += 1
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), batch.column(0).take(pa.array(columns[1], pa.int64())), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64())], ["item", "item_id", "term", "times"])

    kind = items.schema[id_col].dataType.simpleString()
    return small_batches(items).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary")).mapInArrow(run, f"item bigint, item_id {kind}, term string, times bigint")


def search(buckets: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """Each item's k best documents among stored `buckets`, for stored rows of `item_terms`: item_id, rank, doc_id, score.

    Equal scores by ascending doc_id (a null id first), then by the documents' order in the table. Items without a term,
    or whose terms no document holds, have no rows.
    """
    whole = buckets.where("term is null").agg(F.coalesce(F.sum("shard_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("shard_terms"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = F.lit(whole["n"]).cast("long"), F.lit(max(whole["l"], 1)).cast("long")
    words = asked.select("term").distinct()
    small = asked.count() <= SENT_ROWS
    send = F.broadcast if small else (lambda df: df)
    held = buckets.join(send(words), "term")
    df = held.groupBy("term").agg(F.sum(F.size("row")).alias("df"))
    weight = F.floor(SCALE * F.log((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = store(df.select("term", weight.cast("long").alias("w"), F.monotonically_increasing_id().alias("number")))
    each = buckets.join(send(weighed), "term").select("number", "w", F.explode(F.arrays_zip("doc_id", "row", "tf", "n")).alias("at")).select("number", "w", "at.*")
    tf = F.col("tf").cast("long")
    m = 100 - LENGTH_SHARE + F.call_function("div", F.col("n").cast("long") * LENGTH_SHARE * n_docs, n_terms)
    part = F.col("w") * F.call_function("div", tf * 1_000_000_000, tf * 1000 + m * 8)
    parts = each.select("number", "row", "doc_id", part.alias("part"))
    wanted = asked.join(send(weighed.select("term", "number")), "term").select("number", "item", "times")
    if small:  # all of a document's parts come to one task, and the sums need no second shuffle
        parts = parts.repartition("row")
    scores = parts.join(send(wanted), "number").groupBy("item", "row", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row"))
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return best.join(send(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """One row for each item and found document: item_id, rank, doc_id, score.

    Null and empty texts have no terms: such documents are never found and count nowhere, such items have no rows.
    Repeated rows are documents, and items, of their own. Only the ids and texts are read, so other columns may have any
    name. Without documents or items there are no rows.
    """
    asked = store(item_terms(items))
    words = asked.select("term").distinct()
    size = words.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    only = None
    if size["rows"] <= SENT_ROWS and size["bytes"] <= SENT_BYTES:  # what no item asks for need not leave its task
        only = frozenset(r["term"].encode() for r in words.collect())
    return search(store(postings(docs, only)), asked, k)


RANKED_SQL = """
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
postings AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf, (sum(count(*)) OVER (PARTITION BY row))::BIGINT AS n FROM words GROUP BY row, doc_id, term),
whole AS (SELECT count(DISTINCT row)::BIGINT AS nd, count(*)::BIGINT AS l FROM words),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, whole GROUP BY term, nd),
asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))
  GROUP BY item, item_id, term),
scores AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), whole GROUP BY item, item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, row)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
