"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe_batch import bpe_digest
from tidemark.llm.importance import RESAMPLE_SQL, resample
from tidemark.llm.langid import predict_language
from tidemark.llm.lexical import RANKED_SQL, ranked_search
from tidemark.llm.mixing import MIX_SQL, fair_mix
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.passages import repeated_passages
from tidemark.llm.pii import pii_digest
from tidemark.llm.quality import score_quality
from tidemark.llm.urls import URL_SQL, url_verdicts
from tidemark.llm.vectors import TOP_K_SQL, exact_top_k, permutation_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(_table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_passages": op5_passages,
    "op6_quality": op6_quality,
    "op7_permutation": op7_permutation,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_urls": op10_urls,
    "op11_importance": op11_importance,
    "op12_packing": op12_packing,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": TOP_K_SQL,
    "op3_mixing": MIX_SQL,
    "op10_urls": URL_SQL,
    "op11_importance": RESAMPLE_SQL,
    "op13_lexical": RANKED_SQL,
}
