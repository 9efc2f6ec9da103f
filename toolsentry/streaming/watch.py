"""Audits on streams of tool snapshots, built from the same functions as the batch audit."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.operators.drift import def_hash
from toolsentry.operators.findings import finalize
from toolsentry.operators.rules import Rule
from toolsentry.operators.text_scan import TEXT_DETECTORS, tool_findings


def stream_scan(
    tools: DataFrame,
    allowlist: DataFrame | None = None,
    rules: dict[str, list[Rule]] | None = None,
    detectors: Collection[str] = TEXT_DETECTORS,
    id_prefix: str = "",
) -> DataFrame:
    """Findings on a stream of tools. Stateless; the allowlist is a static side."""
    found = finalize(tool_findings(tools, rules, detectors), id_prefix)
    if allowlist is None:
        return found
    columns = found.columns
    everywhere = allowlist.filter(F.col("target").isNull()).select("fingerprint", F.lit(True).alias("_all")).distinct()
    own = allowlist.filter(F.col("target").isNotNull()).select("target", "fingerprint", F.lit(True).alias("_own")).distinct()
    marked = found.join(everywhere, "fingerprint", "left")
    marked = marked.join(own, ["target", "fingerprint"], "left")
    return marked.filter(F.col("_all").isNull() & F.col("_own").isNull()).select(columns)


def stream_drift(tools: DataFrame, baselines: DataFrame, late: str = "1 hour") -> DataFrame:
    """CHANGED and ADDED tools of a snapshot stream, each definition once per ``late`` window.

    ``baselines`` is one snapshot, as ``read_baseline`` gives it: it is joined with every micro-batch as it is,
    without aggregating the history again.

    Repeated captures of one definition are dropped with a watermark, so state stays bounded
    by the definitions seen within the window. A tool missing from a stream proves nothing;
    REMOVED needs a whole snapshot, see ``snapshots``.
    """
    seen = (
        tools.select(
            "target", "tool", "captured_at", def_hash(F.col("description"), F.col("input_schema")).alias("new_hash")
        )
        .withWatermark("captured_at", late)
        .dropDuplicatesWithinWatermark(["target", "tool", "new_hash"])
    )
    known = baselines.select("target", "tool", F.col("def_hash").alias("old_hash"))
    change = F.when(F.col("old_hash").isNull(), F.lit("ADDED")).when(
        F.col("old_hash") != F.col("new_hash"), F.lit("CHANGED")
    )
    return (
        seen.join(known, ["target", "tool"], "left")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("target", "tool", "change", "old_hash", "new_hash", "captured_at")
    )
