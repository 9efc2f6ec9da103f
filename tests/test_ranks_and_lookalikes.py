"""Global positions and names one edit apart, against plain Python."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toolsentry.functions.ranking import positioned
from toolsentry.operators import findings as fnd
from toolsentry.operators import scoring
from toolsentry.operators.lookalikes import lookalikes, typosquat_findings
from toolsentry.operators.manifest_scan import supply_chain_findings
from toolsentry.operators.sieve import bloom_words, may_be_listed, suppress_large
from toolsentry.schemas import FINDINGS


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_positions_are_the_global_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice("abc"), i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "v int, w string, id long").repartition(7)
    got = positioned(frame, [F.col("v").desc_nulls_last(), F.col("w").asc()]).collect()
    assert sorted(r.position for r in got) == list(range(1, 5001)) and sorted((r.v or 0, r.w, r.id) for r in got) == sorted((v or 0, w, i) for v, w, i in rows)
    keys = [(-(r.v or 0), r.w) for r in sorted(got, key=lambda r: r.position)]
    assert keys == sorted(keys)
    assert positioned(frame.filter("id < 0"), [F.col("v").asc()]).collect() == []


def test_reports_keep_their_order(spark):
    rows = [(f"t{i % 3}", "D1", f"R{i % 5}", "x", i % 5, "MCP03", "high", "l", str(i), "", f"{i:012d}", None) for i in range(200)]
    found = spark.createDataFrame(rows, FINDINGS).repartition(5)
    ordered = [(r.severity, r.target, r.fingerprint) for r in fnd.findings_sort(found).collect()]
    placed = sorted(fnd.findings_positions(found).collect(), key=lambda r: r.position)
    assert [(r.severity, r.target, r.fingerprint) for r in placed] == ordered and placed[0].position == 1
    summary = scoring.corpus_summary(found, spark.createDataFrame([(f"t{i}", "path", "gone" if i == 1 else None) for i in range(4)], "target string, kind string, error string"))
    assert [r.target for r in sorted(scoring.corpus_positions(summary).collect(), key=lambda r: r.position)] == [r.target for r in scoring.corpus_sort(summary).collect()]


def test_lookalikes_equal_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 5)))
    names, known = [word() for _ in range(300)] + ["express", "expres", None, ""], [word() for _ in range(120)] + ["express", "x", None]
    frames = [spark.createDataFrame([(n,) for n in some], "name string") for some in (names, known)]
    got = {r.name: r.popular for r in lookalikes(*frames).collect()}
    want = {}
    for n in {n for n in names if n}:
        near = [k for k in known if k and edits(n, k) == 1]
        if near:
            want[n] = min(near)
    assert got == want and len(want) > 50
    plan = lookalikes(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@given(st.text("ab", min_size=1, max_size=6), st.text("ab", min_size=1, max_size=6))
def test_a_shared_neighbour_is_found_whenever_names_are_one_edit_apart(a, b):
    around = lambda s: {s} | {s[:i] + s[i + 1:] for i in range(len(s))}
    assert edits(a, b) != 1 or around(a) & around(b)


def test_a_table_of_popular_names_gives_the_findings_of_the_list(spark, make_files):
    files = make_files({
        "package.json": '{"dependencies": {"expres": "1.0.0", "Lodash": "1.0.0", "lodashh": "1.0.0"}, "devDependencies": {"expres": "2.0.0"}}',
        "a/pyproject.toml": '[project]\ndependencies = ["Request>=1", "numpy"]', "requirements.txt": "panda==1",
    })
    popular = spark.createDataFrame([("express",), ("lodash",), ("requests",), ("pandas",), ("numpy",)], "name string")
    columns = ["target", "rule_id", "severity", "location", "evidence", "title"]
    want = supply_chain_findings(files).filter("rule_id = 'D4-TYPOSQUAT'").select(columns).collect()
    assert sorted(typosquat_findings(files, popular).select(columns).collect()) == sorted(want) and len(want) >= 3


def test_sieved_suppression_equals_the_joins(spark, tmp_path):
    rows = [(f"t{i % 9}", "D1", "R", "x", 1, "MCP03", "high", "l", str(i), "", f"{i % 4000:012x}", None) for i in range(20_000)]
    spark.createDataFrame([*rows, ("t", "D1", "R", "x", 1, "MCP03", "high", "l", "e", "", None, None)], FINDINGS).write.parquet(f"{tmp_path}/f")
    found = spark.read.parquet(f"{tmp_path}/f")
    # most entries name nothing here, some hold everywhere, some in a target that has no such finding
    entries = spark.range(200_000).selectExpr("if(id % 3 = 0, null, concat('t', id % 9)) target", "lpad(lower(hex(if(id % 400 = 0, id % 4000, id + 10000))), 12, '0') fingerprint")
    entries = entries.unionByName(spark.createDataFrame([(None, None), ("t", "")], "target string, fingerprint string"))
    want, got = fnd.suppress(found, entries), suppress_large(found, entries, bits=1 << 20)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() < 20_001
    words = bloom_words(entries.filter("fingerprint is not null"), 1 << 20)
    maybe = found.filter(may_be_listed(words, F.col("target"), F.col("fingerprint"))).count()
    assert 20_001 - want.count() <= maybe < 12_000
    assert sorted(map(str, suppress_large(found, entries.limit(0)).collect())) == sorted(map(str, found.collect()))
