"""Line lists: targets and allowlists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.functions.text import strip

REMOTE_PREFIXES = ["http://", "https://", "git@"]


def targets_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(target, kind, error)``; blank and ``#`` lines are skipped.

    Remote repositories have to be fetched beforehand, so they are listed with an error.
    """
    entry = strip(F.col(value))
    remote = reduce(lambda a, b: a | b, [F.startswith("target", F.lit(p)) for p in REMOTE_PREFIXES])
    return (
        lines.select(entry.alias("target"))
        .filter((F.col("target") != "") & ~F.startswith("target", F.lit("#")))
        .select(
            "target",
            F.when(remote, F.lit("git")).otherwise(F.lit("path")).alias("kind"),
            F.when(remote, F.lit("remote targets must be fetched first")).alias("error"),
        )
    )


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    targets = targets_from_lines(spark.read.text(path))
    if targets.isEmpty():
        raise ValueError(f"no targets in {path}")
    return targets


def allowlist_from_lines(lines: DataFrame, value: str = "value", target: Column | None = None) -> DataFrame:
    """``(target, fingerprint)``; text after ``#`` and blank lines are ignored. A NULL target
    makes the entry count everywhere."""
    entry = strip(F.substring_index(F.col(value), "#", 1))
    owner = F.lit(None).cast("string") if target is None else target
    return lines.select(owner.alias("target"), entry.alias("fingerprint")).filter(F.col("fingerprint") != "").distinct()


def read_allowlist(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of allowlist files that apply to every target."""
    return allowlist_from_lines(spark.read.text(list(paths)))


def allow_union(*allowlists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, allowlists).distinct()
