"""Suppression by an allowlist that is too long to broadcast."""

from toolsentry.operators.sieve import suppress_large
from toolsentry.schemas import FINDINGS


def test_the_filter_of_a_large_allowlist_is_no_part_of_the_plan(spark):
    found = spark.createDataFrame([("t", "D1", "R", "x", 1, "MCP03", "high", "l", "e", "", "a" * 12, None)], FINDINGS)
    entries = spark.createDataFrame([(None, "b" * 12)], "target string, fingerprint string")
    sieved = suppress_large(found, entries)
    assert len(sieved._jdf.queryExecution().toString()) < 200_000
    assert sieved.collect() == found.collect()
