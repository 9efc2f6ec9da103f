"""K-means by subvector dictionaries against whole vectors in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from toolsentry.llm.centroid_clustering import assigned, cluster, encoded

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5):
    points = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
              if v is not None and i is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(points, key=lambda p: (hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1]))[:k]
    centroids = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in points]
    for _ in range(rounds):
        of = [n for _, n in assign()]
        for n in set(of):
            own = [v for (_, v), m in zip(points, of) if m == n]
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    final = assign()
    inertia = {n: sum(d for d, m in final if m == n) for _, n in final}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, inertia[n], sum(inertia.values()), name[n]) for (i, _), (d, n) in zip(points, final))


def vectors(n):
    rng = random.Random(5)
    centres = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(12)]
    rows = [(i * 7 - 50, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(n)]
    return rows + [(9000 + i, rows[3][1]) for i in range(80)]


def test_equals_whole_vectors(spark):
    rows = vectors(300)
    odd = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.1] * 63 + [None]), (6, [0.1] * 63 + [float("nan")]),
           (7, [float("-inf")] + [0.0] * 63), (None, [0.25] * 64), (9000, rows[0][1]), (9000, rows[0][1])]
    frame = spark.createDataFrame([(v, i, 3, "x") for i, v in rows + odd], "embedding array<float>, vec_id long, cluster int, v string").repartition(3)
    got = cluster(frame)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert dict(got.dtypes)["cluster"] == "int" and dict(got.dtypes)["inertia"] == "bigint"
    assert sorted(map(tuple, got.collect())) == brute(rows + odd)


def test_few_vectors_and_none(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.001] * 64)]
    assert sorted(map(tuple, cluster(spark.createDataFrame(few, SCHEMA)).collect())) == brute(few)
    assert cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_out_of_range_are_named(spark):
    with pytest.raises(Exception, match="64 bits"):
        cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)).collect()


@pytest.mark.parametrize("width", [1, 2, 3, 8, 64])
def test_any_width_is_lossless(width):
    rng = np.random.default_rng(width)
    points, centroids = rng.integers(-9, 9, (500, 64)), rng.integers(-9, 9, (7, 64))
    codes, entries, sizes = encoded(points, width)
    nearest, distance = assigned(codes, entries, sizes, centroids, width)
    whole = ((points[:, None] - centroids[None]) ** 2).sum(-1)
    assert (nearest == whole.argmin(1)).all() and (distance == whole.min(1)).all()
