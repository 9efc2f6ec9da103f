"""Counting findings and grading targets. All aggregates combine before they shuffle, so a
target with a large share of the findings costs its partial counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions.ranking import positioned
from toolsentry.functions.text import severity_name

COUNTS = ["critical", "high", "medium", "low", "info"]


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("severity") == fv.SEVERITY_NAMES.index(name.upper())).alias(name) for name in COUNTS
    ]


def severity_counts(findings: DataFrame) -> DataFrame:
    """``(target, total, critical, high, medium, low, info)``."""
    return findings.groupBy("target").agg(F.count("*").alias("total"), *_counts())


def score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """0-100. Severe findings count without limit, hygiene findings up to a cap, and hygiene
    alone never takes a target below the floor."""
    severe = fv.CRITICAL_WEIGHT * critical + fv.HIGH_WEIGHT * high
    hygiene = F.least(F.lit(fv.MEDIUM_CAP), fv.MEDIUM_WEIGHT * medium) + F.least(F.lit(fv.LOW_CAP), low)
    raw = F.greatest(F.lit(0), 100 - severe - hygiene)
    return F.when(severe == 0, F.greatest(F.lit(fv.NO_SEVERE_FLOOR), raw)).otherwise(raw).cast("int")


def letter(points: Column) -> Column:
    (first, bound), *others = fv.GRADE_BOUNDS
    grade = F.when(points >= bound, F.lit(first))
    for name, bound in others:
        grade = grade.when(points >= bound, F.lit(name))
    return grade.otherwise(F.lit("F"))


def listed(targets: DataFrame) -> DataFrame:
    """``(target, error)``, each target once; one that any row lists with an error could not be read."""
    return targets.groupBy("target").agg(F.min("error").alias("error"))


def grade(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target, error, grade, score, total, counts…)``, one row per listed target.

    Targets without findings get full marks; targets that could not be read get no marks at all:
    their grade and score are NULL, and what was found before the error is not counted.
    """
    scanned = F.col("error").isNull()
    counted = listed(targets).join(severity_counts(findings), "target", "left")
    counts = [F.when(scanned, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(c) for c in ["total", *COUNTS]]
    points = score(F.col("critical"), F.col("high"), F.col("medium"), F.col("low"))
    marked = counted.select("target", "error", *counts).withColumn("score", F.when(scanned, points))
    return marked.select("target", "error", F.when(scanned, letter(F.col("score"))).alias("grade"), "score", "total", *COUNTS)


def corpus_summary(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed target, as ``grade`` has it: the table that corpus reports are made of."""
    return grade(findings, targets)


def corpus_totals(summary: DataFrame) -> DataFrame:
    """One row: targets listed and scanned, and every count summed over scanned targets."""
    scanned = F.col("error").isNull()
    return summary.agg(
        F.count("*").alias("targets"),
        F.count_if(scanned).alias("scanned"),
        *[
            F.coalesce(F.sum(F.when(scanned, F.col(c))), F.lit(0).cast("bigint")).alias(c)
            for c in ["total", *COUNTS]
        ],
    )


def worst_first() -> list[Column]:
    return [F.col("score").asc_nulls_last(), F.col("target").asc()]


def corpus_sort(summary: DataFrame) -> DataFrame:
    """Worst score first, unreadable targets last."""
    return summary.orderBy(*worst_first())


def corpus_positions(summary: DataFrame) -> DataFrame:
    """The summary with each target's ``position`` (1, 2, 3 ...) in the order of ``corpus_sort``."""
    return positioned(summary, worst_first())


def gate(findings: DataFrame, targets: DataFrame, fail_on: str = "none") -> DataFrame:
    """``(target, failed, reason)``: whether a target has a finding at or above the threshold.

    A target that could not be read never passes, whatever the threshold; its error is the reason.
    """
    thresholds = {name.lower(): level for level, name in enumerate(fv.SEVERITY_NAMES) if level > fv.INFO}
    threshold = thresholds.get(fail_on.lower())
    unread = F.col("error").isNotNull()
    if threshold is None:
        return listed(targets).select("target", unread.alias("failed"), F.col("error").alias("reason"))
    worst = findings.groupBy("target").agg(F.max("severity").alias("worst"))
    severe = F.coalesce(F.col("worst") >= threshold, F.lit(False))
    found = F.when(severe, F.concat(F.lit("worst finding: "), severity_name(F.col("worst"))))
    return listed(targets).join(worst, "target", "left").select(
        "target", (unread | severe).alias("failed"), F.when(unread, F.col("error")).otherwise(found).alias("reason")
    )


def corpus_gate(summary: DataFrame) -> DataFrame:
    """One row: whether any scanned target has a critical or high finding."""
    severe = F.col("error").isNull() & (F.col("critical") + F.col("high") > 0)
    return summary.agg(F.coalesce(F.bool_or(severe), F.lit(False)).alias("failed"))
