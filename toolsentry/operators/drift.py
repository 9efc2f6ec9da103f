"""Drift between snapshots of declared tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def def_hash(description: Column, input_schema: Column) -> Column:
    """Hash of a tool definition that does not depend on the key order of its schema.

    VARIANT prints object keys sorted at every depth. Text that is no JSON is hashed as is.
    """
    schema = F.coalesce(F.to_json(F.try_parse_json(input_schema)), input_schema, F.lit("{}"))
    return F.sha2(F.concat(F.coalesce(description, F.lit("")), schema), 256)


def baseline_hashes(tools: DataFrame, order_by: str | Column = "captured_at") -> DataFrame:
    """``(target, tool, def_hash, captured_at)`` with the last definition of each tool name."""
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    hashed = tools.select(
        "target", "tool", "captured_at", order.alias("_order"),
        def_hash(F.col("description"), F.col("input_schema")).alias("def_hash"),
    )
    last = F.max_by(F.struct("def_hash", "captured_at"), F.struct("_order", "def_hash"))
    return hashed.groupBy("target", "tool").agg(last.alias("last")).select(
        "target", "tool", "last.def_hash", "last.captured_at"
    )


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest baseline hash of each tool from a table of snapshots."""
    return baselines.groupBy("target", "tool").agg(F.max_by("def_hash", F.struct("captured_at", "def_hash")).alias("def_hash"))


def _compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    new = current.select("target", "tool", F.col("def_hash").alias("new_hash"))
    old = baseline.select("target", "tool", F.col("def_hash").alias("old_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), F.lit("ADDED"))
        .when(F.col("new_hash").isNull(), F.lit("REMOVED"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("CHANGED"))
    )
    return new.join(old, ["target", "tool"], "full_outer").withColumn("change", change)


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(target, tool, change, old_hash, new_hash)`` of tools that differ."""
    return _compared(current, baseline).filter(F.col("change").isNotNull()).select(
        "target", "tool", "change", "old_hash", "new_hash"
    )


def drift_summary(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per target: counts per kind of change, whether it drifted, whether it had a baseline."""
    kinds = ["CHANGED", "ADDED", "REMOVED"]
    return _compared(current, baseline).groupBy("target").agg(
        *[F.count_if(F.col("change") == k).alias(k.lower()) for k in kinds],
        F.bool_or(F.col("change").isNotNull()).alias("drifted"),
        F.bool_or(F.col("old_hash").isNotNull()).alias("has_baseline"),
    )
