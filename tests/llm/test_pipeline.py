"""The pipeline, stage by stage, against plain Python and planted documents."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_packing import check_places
from tests.llm.test_simhash import groups as plain_groups


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    rng = random.Random(21)
    names = ["".join(rng.choice(["th", "er", "on", "ñe", "ing", "est", "re"]) for _ in range(rng.randint(2, 5))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    body = lambda: "\n".join(text(rng.randint(8, 30)) for _ in range(rng.randint(1, 5)))
    items = [(i, text(30) + ". " + text(5)) for i in range(20)]
    rows = {i: body() for i in range(300)}
    rows |= {300 + i: rows[i] for i in range(10)}
    rows |= {320 + i: f"{body()} {items[i][1]} {body()}" for i in range(10)}
    rows |= {340 + i: " ".join(f"{w}$$$" for w in text(60).split()) for i in range(60)}
    rows |= {420 + i: f"{body()} idiot {body()} moron" for i in range(60)}
    rows |= {500: None, 501: ""}
    labels = [(i, int(not 340 <= i < 420), int(420 <= i < 500)) for i in rows if i % 2 == 0 and i < 500]
    home = tmp_path_factory.mktemp("tables")
    made = [(t, i, "en", f"s{i % 3}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(made, "text string, doc_id long, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home)


def test_stages_follow_each_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, tables).cache()
        rows = result.collect()
        if number < 4:
            assert result.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows) and all(r.n_chars == len(r.text or "") for r in rows)
        if number == 0:
            junk = {i for i in before if 340 <= i < 500}
            assert set(after) >= set(before) - junk - {500, 501} and len(set(after) & junk) <= 10
        elif number == 1:
            assert after == {i: t for i, (t, *_) in plain_lines(before).items()}
        elif number == 2:
            kept = {g for _, _, g in plain_groups(list(before.items()))}
            assert after == {i: t for i, t in before.items() if i in kept}
        elif number == 3:
            assert set(before) - set(after) == {i for i in before if 320 <= i < 330}
        else:
            check_places([(r.sequence_id, r.offset, r.length) for r in rows])
            assert {r.doc_id for r in rows} == set(before)
        docs, before = result, after


def test_run_equals_its_stages(spark, tables):
    packed = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
