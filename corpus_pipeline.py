"""A training corpus from documents: score, deduplicate, decontaminate and pack.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes every stage's result below the
shared folder that ``spark.checkpoint.dir`` names and reads it again, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.llm.decontaminate import decontaminated
from toolsentry.llm.line_dedup import line_dedup
from toolsentry.llm.packing import best_fit
from toolsentry.llm.quality import accepted
from toolsentry.llm.simhash import simhash_groups
from toolsentry.llm.tables import landed, table
from toolsentry.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(configure(spark), sf_dir, "labels"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are equal or similar to an earlier one; ``n_chars`` counts what is left."""
    configure(spark)
    lines = line_dedup(docs)
    kept = {"n_chars": F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint"))} if "n_chars" in docs.columns else {}
    return lines.withColumns(kept).select(*docs.columns)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash group; rows without id stay, a repeated id keeps all its rows."""
    configure(spark)
    copies = simhash_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminated(docs, table(configure(spark), sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1024."""
    configure(spark)
    return best_fit(docs, special=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("line dedup", deduplicate_lines),
    ("simhash near-dedup", deduplicate_documents),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: A trained classifier, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    rows = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        rows = landed(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return rows
