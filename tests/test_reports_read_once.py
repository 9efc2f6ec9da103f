"""Reports with several steps make their findings once."""

import __spark_entry__ as entry
import pytest

from surfaces import queries


@pytest.mark.parametrize("name", ["attach_verdict", "json_documents", "sarif_documents", "report_markdown_rows"])
def test_reports_make_their_findings_once(spark, tmp_path, monkeypatch, name):
    """All steps of a report read the rows that the first of them made."""
    made = []
    everything = queries.everything
    monkeypatch.setattr(queries, "everything", lambda *a: made.append(1) or everything(*a))
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert made == [1] and "InMemoryTableScan" in plan
