"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_batch import bpe_digest
from tidemark.llm.mixing import mix_documents
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.pii import redacted
from tidemark.llm.quality import fit_quality, quality_score
from tidemark.llm.shared import small_batches, store

THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts.

    Null and empty texts are scored like others, by features that are all 0. Repeated rows are judged alike and all stay or
    go. Without labels every score is 0.5 and every document stays.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return small_batches(docs).where(quality_score(F.col("text"), model) >= THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8. Of rows with one id, one stays.

    Null and empty texts resemble nothing and stay, as do rows without an id.
    """
    found = store(near_duplicates(docs, k=5, percent=80))
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = store(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(store(gone), "doc_id", "left_anti")
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each span's kind in its place; n_chars follows the new text. Every row stays; null texts stay null, with null n_chars."""
    new = small_batches(docs).withColumn("text", redacted(F.col("text")))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: null and empty texts, without words, never; repeated rows as documents of their own."""
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document. Null texts count as empty; every row is answered."""
    return bpe_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("bpe", bpe)]

#: SQL can't express the first stage, a learned classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. An empty table gives no rows; columns beyond those of `documents` go through to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
