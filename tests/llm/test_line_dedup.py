"""Line deduplication against all pairs."""

import random
import re

from toolsentry.llm.line_dedup import line_dedup, shared_entries



def tokens(line):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", line) if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    lines = sorted(((i, n, line) for i, t in docs.items() if t is not None for n, line in enumerate(t.split("\n"))), key=lambda x: x[:2])
    seen, out = [], {i: [] for i in docs}
    for doc_id, number, line in lines:
        own = tokens(line)
        gone = bool(own) and any(5 * len(own & other) >= 4 * len(own | other) for other in seen)
        out[doc_id].append((line, gone))
        if own:
            seen.append(own)
    return {i: ("\n".join(x for x, g in rows if not g) if docs[i] is not None else None, len(rows), sum(g for _, g in rows)) for i, rows in out.items()}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "é", "ou", "in"]) for _ in range(rng.randint(1, 4)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 60, 90]))) for _ in range(60)]
    docs = {}
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            parts = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                parts[rng.randrange(len(parts))] = word()
            lines.append((" " if rng.random() < 0.8 else " \t ").join(parts) + rng.choice(["", "", " "]))
        docs[i * 2 - 9] = "\n".join(lines)
    docs |= {500: None, 501: "", 502: "\n \n", 503: "Item 1\nItem 2\nItem 1", 504: "x " * 4000 + "\n" + "x " * 4001}
    return docs


def test_equals_all_pairs(spark):
    docs = corpus()
    rows = [(t, i, "own", 3, "z") for i, t in docs.items()]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "text string, doc_id long, tokens string, n_lines int, key string").repartition(3)
    result = line_dedup(frame)
    assert result.columns == ["text", "doc_id", "tokens", "key", "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in result.collect()}
    assert got == brute(docs) and sum(n for *_, n in got.values()) > 60


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (None, "a b"), (2, "a b"), (2, "d\na b")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.text) for r in line_dedup(frame).collect())))
    assert got == sorted(map(str, [(1, "a b\nc"), (1, "a b\nc"), (None, "a b"), (2, ""), (2, "d")]))
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stays_in_the_jvm(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    plan = line_dedup(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_large_clusters_of_near_copies(spark):
    """Copies of one line that differ from each other about as much as the threshold: each meets each."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    docs = {}
    for i in range(400):
        parts = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            parts[rng.randrange(40)] = f"x{rng.randrange(60)}"
        docs[i] = " ".join(parts) + "\n" + " ".join(rng.choice(base) for _ in range(6))
    docs[-1] = " ".join(base[:30])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(frame).collect()}
    assert got == brute(docs) and sum(n for *_, n in got.values()) > 30


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "a\na", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, _gone int, _key int, _doc int, key int, `row` int, `a.b` int")
    result = line_dedup(frame)
    assert result.columns == ["doc_id", "text", "_gone", "_key", "_doc", "key", "row", "a.b", "n_lines", "n_removed"]
    assert tuple(result.first()) == (1, "a", 1, 2, 3, 4, 5, 6, 2, 1)


def test_the_index_moves_once(spark):
    """Leads and numbers of a token come from the shuffle that brings its entries together; tokens of one set go no further."""
    entry = lambda n, at: n << 16 | at
    sets = [((5, 0, 0), 50, 6, [7, 8]), ((3, 1, 0), 30, 9, [9, 7]), ((3, 0, 0), 31, 4, [10]), ((9, 0, 0), 90, 2, None)]
    schema = "first struct<doc_id: long, line_no: int, key: long>, signature long, n int, prefix array<int>"
    index = shared_entries(spark.createDataFrame(sets, schema))
    assert sorted(map(tuple, index.collect())) == [(7, 3, 30, entry(9, 1), 30, entry(9, 1), 2), (7, 5, 50, entry(6, 0), 30, entry(9, 1), 2)]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan and "Aggregate" not in plan
