"""What happens to findings after detection: identity, suppression, notes and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions.ranking import positioned
from toolsentry.functions.text import collapse_spaces, severity_name, sha256_prefix
from toolsentry.schemas import FINDING_COLUMNS

#: A second opinion on a snippet of evidence; None if there is none.
Scorer = Callable[[str], str | None]


def fingerprint(id_prefix: str = "") -> Column:
    """Stable 12-digit id of a finding from its rule, category, location and evidence.

    ``id_prefix`` goes before the rule id; set it to keep allowlists made with prefixed ids.
    """
    parts = ["rule_id", "owasp_id", "location", "evidence"]
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in parts])
    return sha256_prefix(F.concat(F.lit(id_prefix), key), 12)


def finalize(found: DataFrame, id_prefix: str = "") -> DataFrame:
    """Raw hits of any detector in the findings schema."""
    return found.select(
        *FINDING_COLUMNS, fingerprint(id_prefix).alias("fingerprint"), F.lit(None).cast("string").alias("note")
    )


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All findings of all detectors; equal findings stay separate rows."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def _allowed(findings: DataFrame, allowlist: DataFrame, how: str) -> DataFrame:
    """Findings joined with global and per-target entries.

    Fingerprints do not contain the target, so a common finding such as a missing lockfile at
    a root has one fingerprint in very many targets; that key is spread by target.
    """
    everywhere = allowlist.filter(F.col("target").isNull()).select("fingerprint").distinct()
    per_target = allowlist.filter(F.col("target").isNotNull()).select("target", "fingerprint").distinct()
    if how == "left_anti":
        rest = findings.join(everywhere, "fingerprint", how)
        return rest.join(per_target, ["target", "fingerprint"], how)
    marked = findings.join(everywhere.withColumn("_all", F.lit(True)), "fingerprint", "left")
    marked = marked.join(per_target.withColumn("_own", F.lit(True)), ["target", "fingerprint"], "left")
    return marked.filter(F.col("_all") | F.col("_own")).drop("_all", "_own")


def suppress(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Findings that no allowlist entry, global or of their target, names."""
    return _allowed(findings, allowlist, "left_anti").select(findings.columns)


def suppressed_counts(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """``(target, suppressed)`` for targets that lost findings to the allowlist."""
    return _allowed(findings, allowlist, "left").groupBy("target").agg(F.count("*").alias("suppressed"))


def attach_verdict(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set ``note`` from a table of second opinions; missing or blank opinions stay NULL."""
    note = F.nullif(F.substring(collapse_spaces(F.col("note")), 1, fv.NOTE_LIMIT), F.lit(""))
    # one opinion per fingerprint, whichever sorts first, so the join never multiplies findings
    opinions = (
        verdicts.select("fingerprint", note.alias("note"))
        .filter(F.col("note").isNotNull())
        .groupBy("fingerprint")
        .agg(F.min("note").alias("note"))
    )
    columns = findings.columns
    return findings.drop("note").join(opinions, "fingerprint", "left").select(columns)


def review_snippets(findings: DataFrame) -> DataFrame:
    """What a reviewer of findings gets to see: fingerprint and a bounded snippet, nothing else."""
    snippet = F.substring(F.trim("evidence"), 1, fv.SNIPPET_LIMIT)
    return findings.select("fingerprint", snippet.alias("snippet")).filter(F.col("snippet") != "").distinct()


def _judged(scorer: Scorer) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def opinion(snippet: str) -> str | None:
        try:
            return scorer(snippet)
        except Exception:  # a scorer is foreign code: whatever it raises, the finding just has no opinion
            return None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(note=[opinion(s) for s in batch.snippet])

    return judge


def scored_verdicts(findings: DataFrame, scorer: Scorer, path: str, partitions: int | None = None) -> DataFrame:
    """``(fingerprint, note)`` of all findings a scorer has an opinion on, for ``attach_verdict``.

    ``scorer`` takes a snippet and returns its note; it runs in the tasks, once for each distinct snippet, however many findings
    share it. A failure is no opinion. Scores are landed at ``path``, so that no later step calls the scorer again.
    ``partitions`` bounds how many calls run at a time.
    """
    spark = findings.sparkSession
    snippets = review_snippets(findings)
    distinct = snippets.select("snippet").distinct()
    dealt = distinct.repartition(partitions, "snippet") if partitions else distinct
    dealt.mapInPandas(_judged(scorer), "snippet STRING, note STRING").write.mode("overwrite").parquet(path)
    scores = spark.read.schema("snippet STRING, note STRING").parquet(path)
    return snippets.join(scores.filter(F.col("note").isNotNull()), "snippet").select("fingerprint", "note")


def category_label(owasp_id: Column) -> Column:
    """``MCP03: Tool Poisoning``; unknown ids stay as they are."""
    titles = F.create_map(*[F.lit(v) for cid, title, _ in fv.CATEGORIES for v in (cid, title)])
    return F.coalesce(F.concat(owasp_id, F.lit(": "), F.try_element_at(titles, owasp_id)), owasp_id)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.CATEGORIES, "owasp_id STRING, title STRING, coverage STRING")


def coverage_matrix(findings: DataFrame) -> DataFrame:
    """The ten categories, how far a static audit covers them, and their finding counts."""
    counts = findings.groupBy("owasp_id").agg(F.count("*").alias("findings"))
    return (
        categories(findings.sparkSession)
        .join(counts, "owasp_id", "left")
        .withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))
    )


def coverage_gaps(detector_categories: DataFrame) -> DataFrame:
    """Claims that do not hold: covered categories without a detector, or detectors on
    categories declared out of scope. Empty when the coverage table is honest.
    """
    table = categories(detector_categories.sparkSession)
    covered = detector_categories.select("owasp_id").distinct()
    claimed = table.filter(F.col("coverage") != "out_of_scope").select("owasp_id")
    scope = table.filter(F.col("coverage") == "out_of_scope").select("owasp_id")
    return (
        claimed.join(covered, "owasp_id", "left_anti").withColumn("problem", F.lit("no detector"))
        .unionByName(covered.join(scope, "owasp_id", "left_semi").withColumn("problem", F.lit("out of scope")))
    )


def severest_first() -> list[Column]:
    """The order of findings in reports; a total order but for equal findings."""
    return [F.col("severity").desc(), *[F.col(c).asc() for c in ("target", "detector", "location", "rule_id", "fingerprint")]]


def findings_sort(findings: DataFrame) -> DataFrame:
    """Severest first, in a total order."""
    return findings.orderBy(*severest_first())


def findings_positions(findings: DataFrame) -> DataFrame:
    """Findings with their ``position`` (1, 2, 3 ...) in the order of ``findings_sort``, so the order survives any later step."""
    return positioned(findings, severest_first())


def with_severity_label(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_label", severity_name(F.col("severity")))
