"""Registered queries: every operator over the provided tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaces import listings, planted
from toolsentry.functions.text import is_build_path, is_test_path, split_lines
from toolsentry.operators import drift as drifting
from toolsentry.operators import line_scan, manifest_scan, python_scan, scoring, text_scan
from toolsentry.operators import findings as fnd
from toolsentry.operators.rules import POISONING, merge_rules
from toolsentry.operators.sieve import suppress_large
from toolsentry.operators.tool_text import tool_blob, tool_text
from toolsentry.plans.audit import Audit, detector_categories
from toolsentry.session import configure, scratch_path
from toolsentry.sinks import reports, tables
from toolsentry.sources.files import exclude_paths, find_client_configs
from toolsentry.sources.rulepack import findings_by_pack
from toolsentry.streaming.snapshots import snapshot_drift
from toolsentry.streaming.watch import stream_drift, stream_scan

Query = Callable[[SparkSession, str], DataFrame]


def shown(found: DataFrame) -> DataFrame:
    """Findings without their explanatory texts."""
    finished = found if "fingerprint" in found.columns else fnd.finalize(found)
    return finished.select(
        "target", "rule_id", F.col("severity").cast("int").alias("severity"), "owasp_id", "confidence",
        "location", "evidence", "fingerprint",
    )


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all scans before suppression."""
    return Audit(tools=planted.tools(spark, sf_dir), files=planted.all_files(spark, sf_dir)).all_findings()


def landed(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several steps need, made once."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def once(rows: DataFrame) -> DataFrame:
    """Rows that several steps of one lazy plan need, made when the first of them does and kept on disk until the session ends.

    The mark, true of every row, keeps later queries from taking these rows for theirs.
    """
    return rows.filter(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.DISK_ONLY)


def kept_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after suppression, as one lazy plan. A caller with several reports lands it first (``write_findings``)."""
    return fnd.suppress(everything(spark, sf_dir), once(planted.allowlist(spark, sf_dir)))


# -- flattening and text rules --------------------------------------------------------------------


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untouched documents under a pack that raises one rule and adds another."""
    rules = merge_rules(POISONING, [
        {"id": "D1-DIRECTIVE", "severity": "critical", "confidence": "no such level"},
        {"id": "D1-CUSTOM", "pattern": r"(token|key) = ", "severity": "low", "confidence": "low"},
        {"id": "D1-BROKEN", "pattern": "("},
        {"pattern": "entry without id"},
        {"id": "D1-EMPTY"},
    ])
    plain = planted.read(spark, sf_dir, "documents").select(
        F.col("source").alias("target"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("tool"),
        F.col("text").alias("description"), F.lit("{}").alias("input_schema"),
    )
    return shown(text_scan.tool_findings(plain, {POISONING: rules}, ["D1"]))


def target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source under its own pack: one that changes rules, one that comes to nothing, or none."""
    return shown(findings_by_pack(planted.tools(spark, sf_dir), planted.pack_entries(spark, sf_dir), ["D1"]))


def verdicts_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions of a scorer on every distinct snippet, attached to the findings that share it; failures are no opinions."""
    found = landed(kept_findings(spark, sf_dir), "findings")
    verdicts = fnd.scored_verdicts(found, planted.scorer(), scratch_path(spark, "scores"))
    return fnd.attach_verdict(found, verdicts).select("target", "rule_id", "location", "fingerprint", "note")


def only(found: DataFrame, *rules: str) -> DataFrame:
    return shown(found.filter(F.col("rule_id").isin(*rules)))


def text_query(*detectors: str) -> Query:
    return lambda spark, sf_dir: shown(text_scan.tool_findings(planted.tools(spark, sf_dir), None, detectors))


def chat_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(text_scan.passage_findings(planted.chat_turns(spark, sf_dir), F.col("text"), F.col("location")))


def hygiene(*rules: str) -> Query:
    return lambda spark, sf_dir: only(manifest_scan.supply_chain_findings(planted.package_files(spark, sf_dir)), *rules)


def unpinned(npm: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        in_npm = F.contains(F.col("location"), F.lit("package.json"))
        found = manifest_scan.supply_chain_findings(planted.package_files(spark, sf_dir))
        return only(found.filter(in_npm if npm else ~in_npm), "D4-UNPINNED")

    return run


# -- files -------------------------------------------------------------------------------------------


def path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted.code_files(spark, sf_dir).filter(F.col("role") == "source")
    return files.select(
        "target", "path", is_test_path(F.col("path")).alias("in_test"), is_build_path(F.col("path")).alias("in_build")
    )


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.code_files(spark, sf_dir).select("target", "path", "role", "ext")


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude_paths(planted.code_files(spark, sf_dir), ["tests/", "lib/"]).select("target", "path")


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted.raw_text_files(spark, sf_dir)
    lines = files.select("target", "path", F.posexplode(split_lines(F.col("content"))).alias("at", "line"))
    return lines.select("target", "path", (F.col("at") + 1).alias("line_no"), "line")


# -- findings and scores -----------------------------------------------------------------------------


def sieved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed findings, suppressed by the planted allowlist and an entry for every event, which names nothing here."""
    found = landed(everything(spark, sf_dir), "findings")
    foreign = planted.read(spark, sf_dir, "events").select(
        F.lit(None).cast("string").alias("target"), F.substring(F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256), 1, 12).alias("fingerprint"))
    entries = landed(planted.allowlist(spark, sf_dir).unionByName(foreign), "allowlist")
    return shown(suppress_large(found, entries))


def suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.suppressed_counts(everything(spark, sf_dir), once(planted.allowlist(spark, sf_dir)))


def sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = fnd.findings_sort(once(kept_findings(spark, sf_dir)))
    return fnd.with_severity_label(ordered).select("severity_label", "target", "rule_id", "location", "fingerprint")


def findings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fnd.findings_positions(landed(kept_findings(spark, sf_dir), "findings"))
    return fnd.with_severity_label(placed).select("position", "severity_label", "target", "rule_id", "location", "fingerprint")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.grade(kept_findings(spark, sf_dir), planted.targets(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.corpus_summary(kept_findings(spark, sf_dir), planted.targets(spark, sf_dir))


def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_lines(once(summary(spark, sf_dir))).select("target", "line")


def gate_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gate(kept_findings(spark, sf_dir), planted.targets(spark, sf_dir), "high")


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.coverage_gaps(planted.claims(spark, sf_dir))


def detector_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered detectors' claims next to what they found: no claim without findings, no findings without claim."""
    claimed = detector_categories(spark).groupBy("owasp_id").agg(F.lit(True).alias("claimed"))
    found = fnd.coverage_matrix(everything(spark, sf_dir))
    return found.join(claimed, "owasp_id", "left").select("owasp_id", F.coalesce("claimed", F.lit(False)).alias("claimed"), "findings")


def verdicts_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = once(kept_findings(spark, sf_dir))
    digit = F.substring("fingerprint", 2, 1)
    opinion = (
        F.when(digit < "4", F.lit(" \n "))
        .when(digit < "8", F.concat(F.lit("  Likely\n real:  "), "rule_id"))
        .otherwise(F.repeat(F.lit("long  "), F.lit(100)))
    )
    verdicts = found.select("fingerprint", opinion.alias("note"))
    return fnd.attach_verdict(found, verdicts).select("target", "rule_id", "location", "fingerprint", "note")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = fnd.category_label(F.col("owasp_id")).alias("label")
    return kept_findings(spark, sf_dir).groupBy(label).agg(F.count("*").alias("findings"))


# -- reports -------------------------------------------------------------------------------------------


def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and rules read back out of complete documents, those of clean and unread targets too."""
    documents = reports.sarif_documents(once(kept_findings(spark, sf_dir)), planted.targets(spark, sf_dir), size=200)
    result = (
        "ruleId string, level string, "
        "locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint>>>>, "
        "partialFingerprints map<string, string>, properties struct<evidence: string>"
    )
    run = (
        "tool struct<driver: struct<rules: array<struct<id: string>>>>, properties struct<part: bigint, parts: bigint>, "
        "invocations array<struct<toolExecutionNotifications: array<struct<message: struct<text: string>>>>>, "
        f"results array<struct<{result}>>"
    )
    parsed = documents.select("target", F.from_json("document", f"version string, runs array<struct<{run}>>").alias("d"))
    opened = parsed.select("target", "d.version", F.col("d.runs")[0].alias("run"))
    # the rules of a target are those of all its parts
    ids = F.flatten(F.collect_set(F.transform("run.tool.driver.rules", lambda r: r["id"])))
    rules = opened.groupBy("target").agg(F.array_join(F.sort_array(F.array_distinct(ids)), ",").alias("rule_ids"))
    results = opened.select("target", "version", F.get("run.invocations", F.lit(0))["toolExecutionNotifications"][0]["message"]["text"].alias("error"),
                            F.explode_outer("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return results.join(rules, "target").select(
        "target", "version", "rule_ids", "error", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"),
        F.try_element_at("r.partialFingerprints", F.lit("toolsentry/v1")).alias("fingerprint"),
        F.col("r.properties.evidence").alias("evidence"),
    )


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, allowed = once(everything(spark, sf_dir)), once(planted.allowlist(spark, sf_dir))
    documents = reports.json_documents(
        fnd.suppress(found, allowed), planted.targets(spark, sf_dir), fnd.suppressed_counts(found, allowed), size=200
    )
    finding = "id string, severity string, confidence string, location string, evidence string, fingerprint string"
    parsed = F.from_json(
        "document",
        f"server string, error string, count bigint, suppressed bigint, grade string, score int, findings array<struct<{finding}>>",
    )
    return documents.select(parsed.alias("d")).select("d.*", F.explode_outer("d.findings").alias("f")).select(
        F.col("server").alias("target"), "error", "count", "suppressed", "grade", "score", F.col("f.id").alias("rule_id"),
        "f.severity", "f.confidence", "f.location", "f.evidence", "f.fingerprint",
    )


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with their summaries, and two lines of every detail block."""
    lines = reports.markdown_lines(once(kept_findings(spark, sf_dir)), planted.targets(spark, sf_dir))
    rows = F.split("line", "\n")

    def starting(mark: str) -> Column:
        return F.filter(rows, lambda r: F.startswith(r, F.lit(mark)))[0]

    head = F.col("section") == 0
    return lines.filter(F.col("section").isin(0, 4)).select(
        "target", F.when(head, rows[0]).otherwise(starting("- **Evidence:**")).alias("first"),
        F.when(head, rows[2]).otherwise(starting("- **Fingerprint:**")).alias("second"),
    )


# -- drift and streams -------------------------------------------------------------------------------------


def hashes(spark: SparkSession, sf_dir: str, early: bool) -> DataFrame:
    snapshots = planted.snapshots(spark, sf_dir)
    return drifting.baseline_hashes(snapshots.filter(planted.before_cut() if early else ~planted.before_cut()))


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifting.drift(hashes(spark, sf_dir, early=False), hashes(spark, sf_dir, early=True))


def drift_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift against a stored baseline: written as snapshots, the newest read back."""
    path = scratch_path(spark, "baselines")
    tables.write_bucketed_baseline(hashes(spark, sf_dir, early=False), path, "2023", buckets=16)
    for _ in range(2):  # a snapshot that is written again replaces itself
        tables.write_bucketed_baseline(hashes(spark, sf_dir, early=True), path, "2024", buckets=16)
    return drifting.drift(hashes(spark, sf_dir, early=False), tables.read_bucketed_baseline(spark, path))


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifting.drift_summary(hashes(spark, sf_dir, early=False), hashes(spark, sf_dir, early=True))


def streamed(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is available and read what it wrote."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.readStream.schema(planted.read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}*.parquet")


def stream_scan_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = planted.tools_from_documents(stream_of(spark, sf_dir, "documents"))
    return shown(streamed(stream_scan(tools), "scan"))


def stream_drift_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = planted.snapshots_from_events(stream_of(spark, sf_dir, "events"))
    changes = stream_drift(captured, hashes(spark, sf_dir, early=True), late="40 days")
    return streamed(changes, "drift").drop("captured_at")


def stream_snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of whole captures, REMOVED included, from a stream that brings each capture in several micro-batches."""
    rows = planted.captures(spark, sf_dir)
    path = scratch_path(spark, "captures")
    rows.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    snapshot_drift(stream, hashes(spark, sf_dir, early=True), f"{path}/out", f"{path}/state", timedelta(days=40)).awaitTermination()
    kinds = "target STRING, snapshot STRING, tool STRING, change STRING, old_hash STRING, new_hash STRING"
    return spark.read.schema(kinds).parquet(f"{path}/out/drift").drop("batch")


REGISTRY: dict[str, Query] = {
    "tool_text_flatten": lambda s, d: tool_text(planted.tools(s, d)),
    "tool_blob_concat": lambda s, d: tool_blob(planted.tools(s, d)),
    "poisoning_scan": text_query("D1"),
    "comment_smuggle_pages": lambda s, d: only(text_scan.tool_findings(planted.page_tools(s, d), None, ["D1"]), "D1-COMMENT-SMUGGLE"),
    "hidden_unicode": lambda s, d: only(text_scan.tool_findings(planted.tools(s, d), None, ["D1"]), "D1-HIDDEN-UNICODE"),
    "injection_scan": text_query("D6"),
    "conversation_injection": chat_injection,
    "config_injection": lambda s, d: shown(text_scan.config_findings(planted.package_files(s, d))),
    "oversharing_scan": text_query("D7"),
    "tool_secret_scan": text_query("D2"),
    "rule_merge": custom_rules,
    "rule_packs_by_target": target_rules,
    "secret_scan": lambda s, d: shown(line_scan.secret_findings(planted.code_files(s, d))),
    "secret_generic_real": lambda s, d: shown(line_scan.secret_findings(planted.raw_text_files(s, d))),
    "js_sink_scan": lambda s, d: shown(line_scan.js_sink_findings(planted.code_files(s, d))),
    "python_sink_scan": lambda s, d: shown(python_scan.python_sink_findings(planted.code_files(s, d))),
    "install_hooks": hygiene("D4-INSTALL-FETCH-EXEC", "D4-INSTALL-SCRIPT"),
    "npm_unpinned": unpinned(npm=True),
    "python_unpinned": unpinned(npm=False),
    "typosquat": hygiene("D4-TYPOSQUAT"),
    "no_lockfile": hygiene("D4-NO-LOCKFILE"),
    "lock_cover": lambda s, d: manifest_scan.lock_cover(planted.package_files(s, d)),
    "supply_chain_scan": lambda s, d: shown(manifest_scan.supply_chain_findings(planted.package_files(s, d))),
    "shadow_inventory": lambda s, d: shown(manifest_scan.inventory_findings(planted.package_files(s, d))),
    "client_configs": lambda s, d: find_client_configs(planted.package_files(s, d)),
    "manifest_quarantine": lambda s, d: manifest_scan.manifest_errors(planted.package_files(s, d)),
    "unparsed_sources": lambda s, d: python_scan.unparsed_sources(planted.code_files(s, d)),
    "path_context": path_context,
    "file_classes": file_classes,
    "exclude_paths": excluded,
    "line_split": line_split,
    "findings_all": lambda s, d: shown(everything(s, d)),
    "findings_suppressed": lambda s, d: shown(kept_findings(s, d)),
    "findings_sieved": sieved_findings,
    "suppressed_counts": suppressed_counts,
    "findings_sorted": sorted_findings,
    "findings_positions": findings_positions,
    "corpus_positions": lambda s, d: scoring.corpus_positions(landed(summary(s, d), "summary")).select("position", "target", "error", "score"),
    "severity_counts": lambda s, d: scoring.severity_counts(kept_findings(s, d)),
    "grade_by_target": graded,
    "corpus_summary": summary,
    "corpus_totals": lambda s, d: scoring.corpus_totals(summary(s, d)),
    "gate_high": gate_high,
    "corpus_gate": lambda s, d: scoring.corpus_gate(summary(s, d)),
    "corpus_table": corpus_table,
    "coverage_matrix": lambda s, d: fnd.coverage_matrix(kept_findings(s, d)),
    "coverage_check": coverage_check,
    "detector_claims": detector_claims,
    "attach_verdict": verdicts_attached,
    "verdicts_scored": verdicts_scored,
    "owasp_label": labels,
    "sarif_rows": lambda s, d: reports.sarif_rows(kept_findings(s, d)).drop("message"),
    "sarif_documents": sarif_documents,
    "json_documents": json_documents,
    "report_markdown_rows": markdown_rows,
    "review_snippets": lambda s, d: fnd.review_snippets(kept_findings(s, d)),
    "baseline_hash": lambda s, d: hashes(s, d, early=True),
    "drift": drifted,
    "drift_from_tables": drift_from_tables,
    "drift_summary": drift_summary,
    "stream_scan_once": stream_scan_once,
    "stream_drift_once": stream_drift_once,
    "stream_snapshot_drift": stream_snapshot_drift,
    "rules_first_seen": lambda s, d: reports.rules_first_seen(kept_findings(s, d)),
    **listings.QUERIES,
}


def _configured(query: Query) -> Query:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _configured(query) for name, query in REGISTRY.items()}
