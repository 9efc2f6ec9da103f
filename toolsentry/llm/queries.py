"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from toolsentry.llm import oracles
from toolsentry.llm.centroid_clustering import cluster
from toolsentry.llm.debruijn_dedup import debruijn_dedup
from toolsentry.llm.decontaminate import leaks
from toolsentry.llm.kd_sharding import shard_list
from toolsentry.llm.license_scan import license_scan
from toolsentry.llm.line_dedup import line_dedup
from toolsentry.llm.minhash import document_fingerprints
from toolsentry.llm.packing import best_fit
from toolsentry.llm.quality import scored
from toolsentry.llm.resampling import resample
from toolsentry.llm.simhash import simhash_groups
from toolsentry.llm.suffix_dedup import suffix_dedup
from toolsentry.llm.tables import table
from toolsentry.llm.token_counts import token_counts
from toolsentry.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(configure(spark), sf_dir, name))


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = scored(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality_score", "toxic_score", "accepted")


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY: dict[str, Query] = {
    "op1_license_scan": over("documents", license_scan),
    "op2_token_counts": over("documents", lambda docs: token_counts(docs, special=True)),
    "op3_simhash_dedup": over("documents", simhash_groups),
    "op4_document_fingerprints": over("documents", document_fingerprints),
    "op5_best_fit_packing": over("documents", lambda docs: best_fit(docs, special=True)),
    "op6_benchmark_decontamination": benchmark_leaks,
    "op7_suffix_dedup": over("documents", lambda docs: suffix_dedup(docs).drop("kept")),
    "op8_quality_classifier": quality_scores,
    "op9_line_dedup": over("documents", deduplicated_lines),
    "op10_debruijn_dedup": over("documents", lambda docs: debruijn_dedup(docs).drop("kept")),
    "op11_kd_sharding": over("documents", shard_list),
    "op12_centroid_clustering": over("embeddings", cluster),
    "op13_resampling": resampled,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | oracles.oracle_sql()
