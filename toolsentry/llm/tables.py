"""What the operators read, and how they cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.session import scratch_path


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, text, more...)``: a null text is empty, rows without ``doc_id`` are no documents and are
    left out, other columns are not read. Repeated rows stay repeated rows."""
    kept = docs.filter(F.col("doc_id").isNotNull())
    return kept.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_key() -> Column:
    """Tells rows apart that have one ``doc_id`` and different texts."""
    return F.xxhash64("text")


def landed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder that ``spark.checkpoint.dir`` names and read back."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> tuple[pa.Schema, str]:
    """An Arrow schema, and the same in the words ``mapInArrow`` reads."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double",
             pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.float32()): "array<float>"}
    return pa.schema(fields), ", ".join(f"{name} {names[kind]}" for name, kind in fields)


BatchFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
