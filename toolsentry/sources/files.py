"""File tables: classification, pruning, exclusion and the client-config inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions.text import base_name, extension, is_pruned_path
from toolsentry.schemas import FILES

_COLUMNS = [field.split()[0] for field in FILES.split(", ")]


def classify(name: Column) -> Column:
    """``config`` by exact name, else ``lock``, else ``source`` by extension, else ``other``."""
    return (
        F.when(name.isin(fv.CONFIG_NAMES), F.lit("config"))
        .when(name.isin(fv.NPM_LOCKFILES + fv.PYTHON_LOCKFILES), F.lit("lock"))
        .when(extension(name).isin(fv.SOURCE_EXTENSIONS), F.lit("source"))
        .otherwise(F.lit("other"))
    )


def as_files(table: DataFrame, *more: str) -> DataFrame:
    """A table with ``target, path, content`` (and maybe ``location`` and ``name``) in the files
    schema (and the columns ``more``), without anything below pruned directories."""
    location = F.col("location") if "location" in table.columns else F.col("path")
    name = F.col("name") if "name" in table.columns else base_name(F.col("path"))
    return (
        table.filter(~is_pruned_path(F.col("path")))
        .select("target", "path", name.alias("name"), "content", location.alias("location"), *more)
        .withColumn("ext", extension(F.col("name")))
        .withColumn("role", classify(F.col("name")))
        .select(*_COLUMNS, *more)
    )


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed table of file contents; the form to use at scale.

    A table that ``write_files`` made is taken as it is: its ``role`` is the folder a row lies in, so a scan of one role reads
    that folder alone. Any other table is classified by its paths. Rows with an ``error`` hold no content and are left out.
    """
    table = spark.read.format(fmt).load(path)
    if "error" in table.columns:
        table = table.filter(F.col("error").isNull())
    return table.select(_COLUMNS) if set(_COLUMNS) <= set(table.columns) else as_files(table)


def write_files(files: DataFrame, path: str) -> None:
    """Land a files table (or the rows of ``tree_rows``) so that scans read only the roles they need."""
    files.write.mode("overwrite").partitionBy("role").parquet(path)


def exclude_paths(files: DataFrame, substrings: list[str]) -> DataFrame:
    """Drop sources and configs whose printed path contains any substring. Lockfiles stay."""
    kept = F.lit(True)
    for substring in substrings:
        kept = kept & ~F.contains(F.col("location"), F.lit(substring))
    return files.filter((F.col("role") == "lock") | kept)


def find_client_configs(files: DataFrame) -> DataFrame:
    """``(target, path)`` of client configs; reads no contents."""
    return files.filter(F.col("name").isin(fv.CLIENT_CONFIG_NAMES)).select("target", "path")
