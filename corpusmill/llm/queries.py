"""The thin contract queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, extract, jaccard, language, mixing, packing, quality, runs, sketch, store, substrings, tokencount, topk
from .shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_digest(table(spark, sf_dir, "documents"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_digest(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_digest(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_token_store, op3_repeated_spans, op4_language, op5_mix_sources, op6_pack_sequences, op7_count_tokens, op8_jaccard_components, op9_top_k, op10_fingerprints, op11_periodic_runs, op12_centroid_clusters, op13_main_text)}
SQL: dict[str, str] = {"op5_mix_sources": mixing.DIGEST_SQL, "op9_top_k": topk.TOP_K_SQL, "op12_centroid_clusters": centroids.DIGEST_SQL}
