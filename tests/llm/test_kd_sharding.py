"""K-d tree shards: every split is the widest dimension's weighted median, checked against the rows themselves."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from toolsentry.llm.kd_sharding import FINE, dimensions, kd_tree, points, shard_count, shard_list, sharded, with_shard

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, shard string, size int"


def corpus(n, hot=0.4, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        copied = rng.random() < hot
        text = "copied " * 20 if copied else "é" * int(min(rng.paretovariate(1.1), 100) * 20) if rng.random() < 0.9 else rng.choice([None, ""])
        rows.append((text, i * 5 - 300, rng.choice(["en", "de", None]), "hot" if copied else f"s{rng.randrange(9)}", 7, "own", 3))
    return rows


def size_of(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("shards", [16, 5])
def test_every_split_is_a_weighted_median_of_the_widest_dimension(spark, shards):
    docs = spark.createDataFrame([r for r in corpus(1500) if size_of(r[0]) < 2_000], SCHEMA).repartition(4)
    own = points(docs).cache()
    tree = kd_tree(own, shards)
    rows = with_shard(own, tree).collect()
    names = dimensions(own)
    spans = [max(r[d] for r in rows) - min(r[d] for r in rows) or 1.0 for d in names]

    def check(cell, members):
        total = sum(r["size"] for r in members)
        if cell.sides is None:
            assert cell.shards == 1 and {r.shard for r in members} == {cell.first}
            return
        widths = [(max(r[d] for r in members) - min(r[d] for r in members)) / span for d, span in zip(names, spans)]
        assert widths[cell.dimension] == max(widths)
        left, right = ([r for r in members if side.first <= r.shard < side.first + side.shards] for side in cell.sides)
        assert len(left) + len(right) == len(members) and cell.sides[0].shards == cell.shards // 2
        key = lambda r: (r[names[cell.dimension]], r.tie)
        assert max(map(key, left)) <= (cell.place, cell.tie) < min(map(key, right))
        wanted = total * cell.sides[0].shards / cell.shards
        assert abs(sum(r["size"] for r in left) - wanted) <= max(FINE * total / cell.shards, max(r["size"] for r in members))
        check(cell.sides[0], left)
        check(cell.sides[1], right)

    check(tree, rows)


def test_rows_of_the_query(spark):
    rows = corpus(3000) + [("x" * 3_000_000, 99_990, "en", "long", 1, "", 1), ("same", 99_991, "en", "hot", 4, "", 1), ("same", 99_991, "en", "hot", 4, "", 1), ("no id", None, None, None, None, None, None)]
    got = shard_list(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    out = got.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r[1], size_of(r[0]), zlib.crc32((r[0] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    # the long text counts as a shard, and the others share the rest
    held = Counter()
    for r in out:
        held[r.shard] += r["size"]
    rest = sum(held.values()) - 3_000_001
    assert max(held.values()) < 3_000_001 + rest / 15 and sorted(held.values())[-2] < 1.2 * rest / 15
    again = shard_list(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_hot_values_are_split_evenly(spark):
    rows = [("copied text", i, "en", "one", 11, "", 1) for i in range(8000)]
    sizes = Counter()
    for r in shard_list(spark.createDataFrame(rows, SCHEMA)).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) <= 1.01 * min(sizes.values()) + 2 * 12


def test_whole_rows_and_odd_tables(spark):
    docs = spark.createDataFrame(corpus(300), SCHEMA)
    tree = kd_tree(points(docs), 4)
    whole = sharded(docs, tree)
    assert whole.columns == ["text", "doc_id", "lang", "source", "n_chars", "size", "shard"] and whole.count() == 300
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    listed = with_shard(points(docs, "doc_id"), tree)
    assert {(r.doc_id, r.shard) for r in listed.collect()} == {(r.doc_id, r.shard) for r in whole.collect()}
    assert shard_list(docs.limit(0)).collect() == [] and len(shard_list(docs.limit(1)).collect()) == 1
    assert shard_count(docs, 1000) == -(-sum(size_of(r[0]) for r in corpus(300)) // 1000) and shard_count(docs.limit(0), 10) == 1
    bare = spark.createDataFrame([(i, "a" * i) for i in range(50)], "doc_id long, text string")
    assert {r.shard for r in shard_list(bare).collect()} <= set(range(16))


def test_stays_in_the_jvm(spark):
    plan = shard_list(spark.createDataFrame(corpus(50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
