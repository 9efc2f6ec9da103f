"""Importance resampling against plain counting with whole-string hashes."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from hypothesis import given
from hypothesis import strategies as st

from toolsentry.llm.resampling import buckets, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(run.encode()) % 10000 for run in runs]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-r[3], r[0]) for r in rows if r[4] >= 20)
    rank = {i: place for place, (_, i) in enumerate(able[:5 * len(able) // 100], 1)}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def corpus(n):
    rng = random.Random(3)
    names = ["Alpha", "beta", "b9", "ñandú", "日本", "x", "THE", "of", "k" * 300]
    text = lambda: "".join(rng.choice(names) + rng.choice([" ", "\n", "-", "_", "\x7f", "  ", "."]) for _ in range(rng.randint(0, 60)))
    return [(i * 3 - 40, text()) for i in range(n)]


def test_equals_brute_force(spark):
    docs = [*corpus(400), (5000, None), (5001, ""), (5002, "...---"), (5003, "A b"), (5004, "w " * 700_000)]
    target = ["alpha beta b9 the of", None, "", "日本 x THE"]
    frame = spark.createDataFrame([(t, i, 1, "z") for i, t in docs], "text string, doc_id long, n_features int, place string").repartition(5)
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(frame, aims)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    expected = brute(docs, target)
    assert sorted(map(tuple, got.collect())) == expected and sum(r[-1] is not None for r in expected) > 10


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, "a b")] * 2 + [(None, "a b c"), (2, "w " * 30)] + [(3, "w " * 30)] * 30, "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    got = [tuple(r) for r in resample(frame, empty).collect()]
    assert len(got) == 33 and sum(r[0] == 1 for r in got) == 2 and sorted(r[4] for r in got if r[4]) == [1]
    assert resample(empty, frame).collect() == []


@given(st.text(alphabet="aB9 .é日\n", max_size=60), st.integers(1, 9))
def test_parts_lose_no_run(text, limit):
    found = list(buckets(text.encode(), limit))
    n, expected = features(text)
    assert sum(k for k, _ in found) == n and Counter(int(b) for _, part in found for b in part) == Counter(expected)
