"""Captured tool listings as a tools table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTED = "array<struct<name:string,description:string,inputSchema:string,input_schema:string>>"
_PAYLOAD = f"target string, captured_at timestamp, tools {_LISTED}, result struct<tools:{_LISTED}>"


def tools_from_payload(payload: Column, fallback_target: Column) -> list[Column]:
    """Columns of a capture record: its target, time and listed tools."""
    record = F.from_json(payload, _PAYLOAD)
    return [
        F.coalesce(record["target"], fallback_target).alias("target"),
        record["captured_at"].alias("captured_at"),
        F.coalesce(record["tools"], record["result"]["tools"]).alias("tools"),
    ]


def as_tools(captures: DataFrame) -> DataFrame:
    """Rows of ``target, captured_at, tools`` as one row per tool; absent text becomes empty.

    Schemas stay the JSON text they were captured as, so property order survives.
    """
    listed = captures.select("target", "captured_at", F.explode("tools").alias("t"))
    return listed.select(
        "target",
        F.col("t.name").alias("tool"),
        F.coalesce("t.description", F.lit("")).alias("description"),
        F.coalesce("t.inputSchema", "t.input_schema", F.lit("{}")).alias("input_schema"),
        "captured_at",
    )


def read_captures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Captures in JSON lines: ``{target, captured_at, tools: [...]}`` or a protocol reply
    ``{target, result: {tools: [...]}}``; lines that do not parse are dropped. The file name
    stands in for a missing target."""
    lines = spark.read.text(path)
    captures = lines.select(*tools_from_payload(F.col("value"), F.col("_metadata.file_name")))
    return as_tools(captures)


def inspect_tools(tools: DataFrame) -> DataFrame:
    """One JSON line per declared tool: name, description and schema."""
    record = F.struct(
        F.col("tool").alias("name"), "description", F.try_parse_json("input_schema").alias("input_schema")
    )
    return tools.select("target", F.to_json(record).alias("value"))
