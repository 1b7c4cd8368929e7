"""Operator 3: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to `max_epochs` times. A copy's virtual finish
time is the running total of its source's words up to and including it, divided by the source's target. All copies are
ordered by finish time and the order is cut where the words of the next copy would pass the total budget.

The running totals never gather a source in one task: a source's documents are dealt into ranges of their shuffle key,
the ranges' sums are added up, and only inside a range are rows ordered. The global cut is found likewise, from a
histogram of finish times; only the range that holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.shared import store

#: Documents that share one range of shuffle keys, about.
RANGE_ROWS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row a source: source, source_rank, source_size, n_docs, target.

    Sources by code point (null last) take the weights in turn. The budget is the size of all sources. A source stops at
    `max_epochs` times its size; what it leaves is shared by weight among the rest. Ordered by limit over weight, the
    sources that stop come first, so one pass of running sums finds them; sums are of integers and exact.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = sources.withColumn("source_rank", F.row_number().over(every) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("long"))
    sources = sources.withColumn("most", F.col("source_size") * max_epochs)
    sources = sources.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = Window.orderBy(F.col("most") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))
    sharing = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("stops", left * F.col("weight") > F.col("most") * sharing)
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(whole)
    weight_left = F.col("weights") - F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0)).over(whole)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise((F.col("weight") * rest).cast("double") / weight_left.cast("double"))
    return sources.select("source", F.col("source_rank").cast("long"), "source_size", "n_docs", target.alias("target"))


def _finish(epoch: Column) -> Column:
    """Virtual finish time of a document's copy in the given epoch."""
    return F.coalesce((epoch * F.col("source_size") + F.col("running")).cast("double") / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (whole copies only, repeats counted).

    Null or empty texts have size 0 and take 0. A null source is a source of its own and comes last. Repeated rows are
    documents of their own; rows alike in every way share one place's neighbours and it doesn't matter which is which.
    Only doc_id, source and text are read. No rows in, no rows out. The shuffle key is MD5 of the seed and the id, so
    reruns agree.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    sources = source_targets(sized, weights, max_epochs)
    n_ranges = F.least(F.greatest(F.ceil(F.col("n_docs") / RANGE_ROWS), F.lit(1)), F.lit(1 << 20)).cast("long")
    spot = F.conv(F.substring("key", 1, 5), 16, 10).cast("long")
    dealt = sized.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    dealt = dealt.withColumn("range", F.floor(spot * n_ranges / (1 << 20)).cast("long"))

    sums = dealt.groupBy("source_rank", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_rank", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = dealt.withColumn("inside", F.sum("size").over(inside)).join(sums, ["source_rank", "range"])
    queued = store(queued.select("doc_id", "source", "size", "source_size", "target", "source_rank", "key", (F.col("before") + F.col("inside")).alias("running")))

    facts = sized.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    steps = min(max(1024, facts["n"] // RANGE_ROWS), 1 << 18)
    # No copy can be taken that finishes far beyond 1: the targets add up to the budget.
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", _finish(F.col("epoch"))).withColumn("step", F.floor(F.least(F.col("finish"), F.lit(16.0)) * steps).cast("long"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps_upto = copies.groupBy("step").agg(F.sum("size").alias("words")).select("step", F.sum("words").over(upto).alias("upto"), "words")
    over = steps_upto.where(F.col("upto") > (facts["total"] or 0)).orderBy("step").first()
    place = F.struct("finish", "source_rank", "key", "doc_id")
    if over is None:
        taken = F.col("size") * max_epochs
    else:
        order = Window.partitionBy("step").orderBy("finish", "source_rank", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        near = copies.where(F.col("step") == over["step"]).withColumn("words_upto", F.sum("size").over(order) + (over["upto"] - over["words"]))
        last = near.where(F.col("words_upto") <= facts["total"]).agg(F.max(place).alias("last")).first()["last"]
        taken = F.lit(0).cast("long")
        for epoch in range(max_epochs):
            finish = _finish(F.lit(epoch))
            sure = F.floor(F.least(finish, F.lit(16.0)) * steps) < over["step"]
            if last is not None:
                here = F.struct(finish.alias("finish"), F.col("source_rank"), F.col("key"), F.col("doc_id"))
                cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["source_rank"]).cast("long").alias("source_rank"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"))
                sure = sure | (here <= cut)
            taken = taken + F.when(sure, F.col("size")).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast(T.LongType()).alias("taken"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, source_size * 3 AS most,
         sum(source_size) OVER ()::BIGINT AS total
  FROM by_source),
filled AS (
  SELECT *, (total - coalesce(sum(most) OVER before, 0)) * weight
            > most * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS stops
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_rank, source_size, total,
         CASE WHEN stops THEN most::DOUBLE
              ELSE (weight * (total - coalesce(sum(most) FILTER (stops) OVER (), 0)))::DOUBLE
                   / (sum(weight) OVER () - coalesce(sum(weight) FILTER (stops) OVER (), 0))::DOUBLE END AS target
  FROM filled),
queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.source_rank, t.target, t.total, s.key,
         sum(s.size) OVER (PARTITION BY t.source_rank ORDER BY s.key, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, coalesce((epoch * source_size + running)::DOUBLE / nullif(target, 0), 0) AS finish
  FROM queued, (VALUES (0), (1), (2)) e(epoch)),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, key, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM copies)
SELECT doc_id, source, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       coalesce(sum(size) FILTER (words <= total), 0)::BIGINT AS taken
FROM ordered GROUP BY doc_id, source, key
"""


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns, whatever those are called.

    Within a source the mix takes the first documents of the shuffled order once more often than the rest. So one row a
    source (how often, and the last document that is taken so often) tells every document's copies, and the texts need
    no shuffle. Null and empty texts, and texts without words, are not taken. A null source is a source of its own.
    Repeated rows are documents of their own and are taken alike. No rows in, no rows out.
    """
    mixed = fair_mix(docs, weights, max_epochs, seed)
    place = lambda id: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))).alias("key"), id.alias("id"))
    counted = mixed.where("size > 0").select("source", (F.col("taken") / F.col("size")).cast("int").alias("copies"), place(F.col("doc_id")).alias("place"))
    per_source = store(counted.groupBy("source", "copies").agg(F.max("place").alias("last")).groupBy(F.col("source").alias("of")).agg(F.max_by("last", "copies").alias("last"), F.max("copies").alias("copies")))
    told = docs.select(F.struct("*").alias("row")).join(per_source, F.col("row.source").eqNullSafe(F.col("of")))
    copies = F.when(place(F.col("row.doc_id")) <= F.struct(F.col("last.key").alias("key"), F.col("last.id").alias("id")), F.col("copies")).otherwise(F.col("copies") - 1)
    told = told.where(F.col("row.text").rlike(WORD)).withColumn("copies", copies).where("copies > 0")
    return told.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
