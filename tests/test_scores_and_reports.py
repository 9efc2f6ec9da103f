"""Identity, suppression, grades, reports and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from toolsentry.operators import drift, findings as fnd, scoring
from toolsentry.plans.audit import detector_categories
from toolsentry.schemas import ALLOWLIST, TARGETS, VERDICTS
from toolsentry.sinks import reports, tables

RAW = (
    "target string, detector string, rule_id string, title string, severity tinyint, owasp_id string, "
    "confidence string, location string, evidence string, recommendation string"
)


@pytest.fixture(scope="module")
def make_findings(spark):
    def make(spec):
        """``spec``: target -> list of (rule, severity, location, evidence)."""
        rows = [(t, "D", rule, f"Title {rule} {where}", sev, "MCP04", "high", where, ev, "Fix it.")
                for t, found in spec.items() for rule, sev, where, ev in found]
        return fnd.finalize(spark.createDataFrame(rows, RAW).coalesce(2))

    return make


def make_targets(spark, *names, failed=()):
    rows = [(n, "path", None) for n in names] + [(n, "git", "not fetched") for n in failed]
    return spark.createDataFrame(rows, TARGETS).coalesce(1)


def some(n, severity, rule="R"):
    return [(rule, severity, f"f{i}:{i + 1}", "e") for i in range(n)]


def test_fingerprints_identify_rule_place_and_evidence(make_findings):
    rows = make_findings({"a": [("X", 3, "l", "e"), ("Y", 3, "l", "e"), ("X", 3, "m", "e"), ("X", 1, "l", "e")], "b": [("X", 3, "l", None)]})
    prints = [r.fingerprint for r in rows.collect()]
    assert len(set(prints)) == 4 and all(len(p) == 12 for p in prints)


def test_grades_cap_hygiene_and_floor_without_severe(spark, make_findings):
    found = make_findings({"lows": some(50, 1), "meds": some(10, 2) + some(50, 1), "highs": some(3, 3), "worst": some(3, 4), "info": some(9, 0), "unread": some(1, 4)})
    got = {r.target: (r.grade, r.score, r.total) for r in
           scoring.grade(found, make_targets(spark, "lows", "meds", "highs", "worst", "info", "clean", failed=["unread"])).collect()}
    assert got == {"unread": (None, None, 0), "lows": ("A", 90, 50), "meds": ("C", 70, 60), "highs": ("F", 55, 3), "worst": ("F", 0, 3),
                   "info": ("A", 100, 9), "clean": ("A", 100, 0)}
    letters = spark.range(0, 101).select("id", scoring.letter(F.col("id")).alias("g"))
    assert {r.g: r.n for r in letters.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"A": 11, "B": 10, "C": 10, "D": 10, "F": 60}


def test_corpus_summary_totals_gate_and_order(spark, make_findings):
    found = make_findings({"bad": some(1, 3) + some(2, 1), "ok": some(1, 2)})
    summary = scoring.corpus_summary(found, make_targets(spark, "bad", "ok", failed=["https://x"]))
    rows = scoring.corpus_sort(summary).collect()
    assert [(r.target, r.grade, r.score, r.total) for r in rows] == [("bad", "B", 83, 3), ("ok", "A", 95, 1), ("https://x", None, None, 0)]
    totals = scoring.corpus_totals(summary).first()
    assert (totals.targets, totals.scanned, totals.total, totals.high, totals.low) == (3, 2, 4, 1, 2)
    assert scoring.corpus_gate(summary).first().failed
    gates = {t: {r.target: r.failed for r in scoring.gate(found, make_targets(spark, "bad", "ok", "none"), t).collect()}
             for t in ("high", "medium", "none", "strange")}
    assert gates["high"] == {"bad": True, "ok": False, "none": False} and gates["medium"]["ok"]
    assert not any(gates["none"].values()) and not any(gates["strange"].values())
    for threshold in ("high", "none"):
        rows = scoring.gate(found, make_targets(spark, "ok", failed=["https://x"]), threshold).collect()
        assert {r.target: (r.failed, r.reason) for r in rows} == {"ok": (False, None), "https://x": (True, "not fetched")}


def test_suppression_is_global_or_per_target(spark, make_findings):
    found = make_findings({"a": [("X", 3, "l", "e"), ("Y", 3, "l", "e")], "b": [("X", 3, "l", "e"), ("Y", 3, "l", "e"), ("Y", 3, "l", "e")]})
    prints = {r.rule_id: r.fingerprint for r in found.collect()}
    allow = spark.createDataFrame([(None, prints["X"]), (None, prints["X"]), ("b", prints["Y"]), ("a", "ffff")], ALLOWLIST)
    assert [(r.target, r.rule_id) for r in fnd.suppress(found, allow).collect()] == [("a", "Y")]
    assert {r.target: r.suppressed for r in fnd.suppressed_counts(found, allow).collect()} == {"a": 1, "b": 3}


def test_allow_add_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "allow")
    entry = spark.createDataFrame([(None, "abc"), ("t", "abc")], ALLOWLIST)
    spark.createDataFrame([], ALLOWLIST).write.parquet(path)
    for _ in range(2):
        tables.allow_add(entry, spark.read.schema(ALLOWLIST).parquet(path), path)
    assert spark.read.schema(ALLOWLIST).parquet(path).count() == 2


def test_verdicts_attach_without_multiplying(spark, make_findings):
    found = make_findings({"a": [("X", 3, "l", "e"), ("Y", 3, "l", "e"), ("Z", 3, "l", " s " * 500)]})
    prints = {r.rule_id: r.fingerprint for r in found.collect()}
    verdicts = spark.createDataFrame(
        [(prints["X"], "  real \n threat "), (prints["X"], "zzz"), (prints["Y"], "  "), ("none", "x"), (prints["Z"], "w" * 400)], VERDICTS)
    notes = {r.rule_id: r.note for r in fnd.attach_verdict(found, verdicts).collect()}
    assert notes == {"X": "real threat", "Y": None, "Z": "w" * 300}
    assert max(len(r.snippet) for r in fnd.review_snippets(found).collect()) <= 800


def test_coverage_is_honest(spark, make_findings):
    assert fnd.coverage_gaps(detector_categories(spark)).isEmpty()
    wrong = spark.createDataFrame([("x", "MCP02")], "scan string, owasp_id string")
    assert fnd.coverage_gaps(wrong).filter("problem = 'out of scope'").count() == 1
    matrix = {r.owasp_id: (r.coverage, r.findings) for r in fnd.coverage_matrix(make_findings({"a": some(3, 1)})).collect()}
    assert len(matrix) == 10 and matrix["MCP04"] == ("partial", 3) and matrix["MCP02"] == ("out_of_scope", 0)
    labels = spark.createDataFrame([("MCP03",), ("X9",)], "c string").select(fnd.category_label(F.col("c")).alias("l")).collect()
    assert [r.l for r in labels] == ["MCP03: Tool Poisoning", "X9"]


def test_sarif_documents_hold_everything_in_parts(spark, make_findings):
    same = [("DUP", 2, "here", "same")] * 60
    found = make_findings({"small": some(3, 3) + [("Q", 1, "a\\b.py:7", "e"), ("Q", 0, "pkg :: dep", "e")], "hot": some(40, 2) + same})
    docs = reports.sarif_documents(found, make_targets(spark, "small", "hot", "empty", failed=["unread"]), size=5).collect()
    parsed = [(r.target, json.loads(r.document)) for r in docs]
    sizes, failed = {}, {}
    for target, doc in parsed:
        run = doc["runs"][0]
        results = run["results"]
        assert doc["version"] == "2.1.0" and run["properties"]["parts"] == (20 if target == "hot" else 1)
        sizes.setdefault(target, {})[run["properties"]["part"]] = len(results)
        failed[target] = run.get("invocations")
        ids = [rule["id"] for rule in run["tool"]["driver"]["rules"]]
        assert len(ids) == len(set(ids)) and {r["ruleId"] for r in results} == set(ids)
    assert sizes["small"] == {1: 5} and sum(sizes["hot"].values()) == 100 and max(sizes["hot"].values()) < 20
    assert sorted(sizes["hot"]) == list(range(1, 21)) and sizes["empty"] == sizes["unread"] == {1: 0}
    assert failed["empty"] is None and failed["unread"][0]["executionSuccessful"] is False
    assert failed["unread"][0]["toolExecutionNotifications"][0]["message"]["text"] == "not fetched"
    small = next(d for t, d in parsed if t == "small")["runs"][0]
    assert [r["level"] for r in small["results"]] == ["error"] * 3 + ["note"] * 2
    places = [r["locations"][0]["physicalLocation"] for r in small["results"]]
    assert places[3] == {"artifactLocation": {"uri": "a/b.py"}, "region": {"startLine": 7}}
    assert places[4] == {"artifactLocation": {"uri": "(declared-tool-surface)"}}
    assert small["properties"]["server"] == "small" and len(small["results"][0]["partialFingerprints"]) == 1


def test_sarif_locations(spark):
    places = ["a/b.py:7", "http://h:8000/m :: tool 'x' (description)", "pkg :: dep", "c:\\d\\e.ts:12"]
    df = spark.createDataFrame([(p,) for p in places], "l string").select(reports.sarif_location(F.col("l")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [
        ("a/b.py", 7), ("http://h", 8000), ("(declared-tool-surface)", None), ("c:/d/e.ts", 12)]


def test_rules_first_seen(make_findings):
    rows = reports.rules_first_seen(make_findings({"a": [("R", 1, "b", "e"), ("R", 1, "a", "e"), ("S", 2, "c", "e")]})).collect()
    assert {(r.rule_id, r.title) for r in rows} == {("R", "Title R a"), ("S", "Title S c")}


def test_json_documents(spark, make_findings):
    found = make_findings({"a": some(1, 3) + some(1, 1)})
    suppressed = spark.createDataFrame([("a", 4)], "target string, suppressed bigint")
    docs = {r.target: json.loads(r.document) for r in
            reports.json_documents(found, make_targets(spark, "a", "none", failed=["unread"]), suppressed).collect()}
    a = docs["a"]
    assert (a["server"], a["count"], a["suppressed"], a["grade"], a["score"]) == ("a", 2, 4, "B", 84)
    assert [f["severity"] for f in a["findings"]] == ["HIGH", "LOW"] and a["findings"][0]["llm_note"] is None
    assert docs["none"]["findings"] == [] and docs["none"]["grade"] == "A" and (a["part"], a["parts"], a["error"]) == (1, 1, None)
    unread = docs["unread"]
    assert (unread["error"], unread["grade"], unread["score"], unread["count"]) == ("not fetched", None, None, None)


def test_markdown_reads_as_one_document_per_target(spark, make_findings, tmp_path):
    found = make_findings({"a": some(2, 1) + some(1, 4), "b": some(1, 0)})
    suppressed = spark.createDataFrame([("a", 2)], "target string, suppressed bigint")
    lines = reports.markdown_lines(found, make_targets(spark, "a", "b", "c", failed=["unread"]), suppressed)
    path = tmp_path / "md"
    reports.write_markdown(lines, str(path), buckets=2)
    assert len(list(path.glob("bucket=*"))) <= 2
    rows = [json.loads(line) for p in sorted(path.glob("bucket=*/part-*")) for line in p.read_text().splitlines()]
    texts = {t: "".join(r["line"] + "\n" for r in rows if r["target"] == t) for t in ("a", "b", "c", "unread")}
    assert "**Not audited:** not fetched" in texts["unread"] and "Grade" not in texts["unread"]
    assert texts["a"].startswith("# Audit report: `a`\n\n**Grade: F (58/100)** · **3 findings** (CRITICAL: 1, LOW: 2)\n\n_2 finding")
    table = [line.split(" | ")[0] for line in texts["a"].splitlines() if line.startswith("| ") and "`" in line]
    assert table == ["| CRITICAL", "| LOW", "| LOW"] and texts["a"].count("#### ") == 3
    assert "(none above INFO)" in texts["b"] and "| MCP10 | Context Injection & Over-Sharing | \U0001f7e1 partial |" in texts["c"]
    assert "## Findings" not in texts["c"]


def test_corpus_outputs(spark, make_findings, tmp_path):
    summary = scoring.corpus_summary(make_findings({"bad": some(1, 3)}), make_targets(spark, "bad", "ok", failed=["git@x"]))
    reports.write_corpus(summary, str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert "Scanned 2 of 3 targets. Aggregate: 0 critical, 1 high" in text
    assert text.rstrip().splitlines()[-3:] == [
        "| bad | B (85) | 1 | 0 | 1 | 0 | 0 | 0 |", "| ok | A (100) | 0 | 0 | 0 | 0 | 0 | 0 |", "| git@x | error | - | - | - | - | - | - |"]
    reports.write_corpus(summary, str(tmp_path / "js"), "json")
    assert spark.read.json(str(tmp_path / "js" / "aggregate")).first().high == 1


def test_findings_and_baseline_tables(spark, make_findings, tmp_path):
    found = make_findings({"a": some(3, 1)})
    tables.write_findings(found, str(tmp_path / "f"), "json")
    assert spark.read.json(str(tmp_path / "f")).count() == 3
    ordered = [(r.severity, r.target) for r in fnd.findings_sort(make_findings({"b": some(2, 1), "a": some(1, 3) + some(1, 1)})).collect()]
    assert ordered == [(3, "a"), (1, "a"), (1, "b"), (1, "b")]


def test_drift_kinds_and_last_definition_wins(spark, tmp_path):
    schema = "target string, tool string, description string, input_schema string, captured_at timestamp, pos int"
    rows = [("s", t, d, j, None, i) for i, (t, d, j) in enumerate([
        ("same", "d", '{"a": 1, "b": {"y": 1, "x": 2}}'), ("dup", "old", "{}"), ("dup", "new", "{}"), ("gone", "g", "{}"), ("edit", "e", "{}")])]
    now = [("s", t, d, j, None, i) for i, (t, d, j) in enumerate([
        ("same", "d", '{"b": {"x": 2, "y": 1}, "a": 1}'), ("dup", "new", "{ }"), ("edit", "e!", "{}"), ("fresh", "f", "{}")])]
    old, new = [drift.baseline_hashes(spark.createDataFrame(r, schema).repartition(3), "pos") for r in (rows, now)]
    assert {(r.tool, r.change) for r in drift.drift(new, old).collect()} == {("edit", "CHANGED"), ("fresh", "ADDED"), ("gone", "REMOVED")}
    other = spark.createDataFrame([("new", "t", "h")], "target string, tool string, def_hash string")
    summary = {r.target: (r.changed, r.added, r.removed, r.drifted, r.has_baseline) for r in
               drift.drift_summary(new.select("target", "tool", "def_hash").unionByName(other), old).collect()}
    assert summary == {"s": (1, 1, 1, True, True), "new": (0, 1, 0, True, False)}
    path = str(tmp_path / "base")
    for snapshot in ("one", "two", "two"):
        tables.write_baseline(old, path, snapshot)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * old.count() and stored.select(F.length("label_key")).first()[0] == 16
    assert drift.latest_baseline(stored).count() == 4
