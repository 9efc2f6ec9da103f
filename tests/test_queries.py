"""Registered queries against their SQL on the smallest tables, and the shape of plans."""

import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from surfaces import planted
from toolsentry.operators import line_scan, manifest_scan, text_scan
from toolsentry.plans.audit import Audit
from toolsentry.sources.files import read_files, write_files

SF = "/root/testdata/sf0.001"
CHECKED = ["tool_text_flatten", "poisoning_scan", "rule_merge", "js_sink_scan", "supply_chain_scan", "grade_by_target",
           "sarif_documents", "json_documents", "report_markdown_rows", "corpus_table", "gate_high", "unparsed_sources", "coverage_check",
           "detector_claims", "drift_summary", "stream_drift_once"]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, database, name):
    result = entry.queries()[name](spark, SF)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert compare.rows(result.columns, result.collect()) == compare.rows(names, cursor.fetchall())


def test_every_query_has_sql():
    from surfaces import oracles, queries

    assert set(queries.queries()) == set(oracles.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_scan_neither_shuffles_nor_leaves_the_jvm(spark, tmp_path):
    planted.tools(spark, SF).write.parquet(str(tmp_path / "tools"))
    plan = plan_of(text_scan.tool_findings(spark.read.parquet(str(tmp_path / "tools"))))
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert re.search(r"ReadSchema: struct<target:string,tool:string,description:string,input_schema:string>", plan)


def test_scans_of_a_files_table_read_what_they_need(spark, tmp_path):
    write_files(planted.all_files(spark, SF), str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    lines = plan_of(line_scan.line_findings(files))
    assert "Exchange" not in lines and "Python" not in lines
    assert re.search(r"PartitionFilters: \[[^]]*role", lines)
    cover = plan_of(manifest_scan.lock_cover(files))
    assert "content" not in cover and "CartesianProduct" not in cover and "NestedLoop" not in cover
    assert read_files(spark, str(tmp_path / "files")).count() == files.count()


def test_an_audit_reads_contents_once_for_each_role(spark, tmp_path):
    """Over a landed table: every scan is pruned by role; configs are read once and once more for TOML, sources twice."""
    write_files(planted.all_files(spark, SF), str(tmp_path / "files"))
    plan = plan_of(Audit(files=read_files(spark, str(tmp_path / "files"))).all_findings())
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters.*?ReadSchema: (\S+)", plan)
    assert len(scans) == plan.count("FileScan") and all("role" in pruned for pruned, _ in scans)
    contents = [re.search(r"role#\d+ = (\w+)", pruned)[1] for pruned, read in scans if "content" in read]
    assert sorted(contents) == ["config", "config", "source", "source"]


def test_scans_together_find_what_they_find_alone(spark):
    files = planted.all_files(spark, SF).persist()
    together = Audit(files=files).all_findings()
    alone = [Audit(files=files, scans=[name]).all_findings() for name in ("config_texts", "lines", "python_calls", "manifests")]
    rows = lambda *parts: sorted(tuple(map(str, r)) for part in parts for r in part.collect())
    assert rows(together) == rows(*alone)
    assert rows(Audit(files=files, scans=["lines", "config_texts"]).all_findings()) == rows(alone[0], alone[1])
    files.unpersist()


def test_lock_cover_reads_manifests_and_lockfiles_only(spark, tmp_path):
    write_files(planted.all_files(spark, SF), str(tmp_path / "files"))
    cover = plan_of(manifest_scan.lock_cover(spark.read.parquet(str(tmp_path / "files"))))
    scans = re.findall(r"PartitionFilters: \[(.*?)\]", cover)
    assert len(scans) == 2 and all("role" in s for s in scans)


def test_plans_do_not_depend_on_splits(spark, tmp_path):
    documents = planted.read(spark, SF, "documents")
    shapes = []
    for n in (1, 40):
        documents.repartition(n).write.mode("overwrite").parquet(f"{tmp_path}/{n}/documents.parquet")
        plan = plan_of(entry.queries()["poisoning_scan"](spark, f"{tmp_path}/{n}"))
        shapes.append(re.findall(r"^[ :+*()\d-]*(\w+)", plan, re.M))
    assert shapes[0] == shapes[1]


def test_queries_are_built_without_writing(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a query that is only built writes nothing")

    monkeypatch.setattr("surfaces.queries.scratch_path", refuse)
    for name in ("findings_suppressed", "grade_by_target", "attach_verdict", "sarif_documents", "json_documents", "corpus_table"):
        assert entry.queries()[name](spark, SF).columns


def test_package_reaches_workers_from_any_folder(tmp_path):
    """Another working folder, no PYTHONPATH: Python workers get the package from the session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from toolsentry.session import local_session\n"
        "s = local_session('2')\n"
        f"print('ROWS', e.queries()['python_sink_scan'](s, {SF!r}).count(), e.queries()['unparsed_sources'](s, {SF!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    rows = re.search(r"ROWS (\d+) (\d+)", done.stdout)
    assert rows and int(rows[1]) > 0 and int(rows[2]) > 0, done.stderr[-2000:]


def test_repeating_a_target_repeats_its_findings_only(spark):
    tools = planted.tools(spark, SF)
    once = Audit(tools=tools).findings().groupBy("fingerprint").count()
    other = tools.unionByName(tools.withColumn("target", F.lit("copy")))
    doubled = Audit(tools=other).findings().filter("target <> 'copy'").groupBy("fingerprint").count()
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, doubled.collect()))
