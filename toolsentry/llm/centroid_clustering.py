"""K-means over integer vectors by dictionaries of subvectors.

Vectors are cut into blocks of a few neighbouring components. Groups of vectors are encoded once, without loss: each block
keeps its distinct subvectors as a dictionary and every vector one code for each block. A round then computes the
squared distance of every dictionary entry to every centroid's block, once, and a vector's distance is the sum of the
entries its codes point at. Rounds read codes and dictionaries from the scratch folder, never the vectors, and shuffle one
row of sums for each task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.tables import arrow_schema, landed

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Components in a block. Two keep dictionaries small: entries are pairs of integers, which vectors share.
WIDTH = 2
#: Vectors encoded together; bounds what a task holds.
GROUP_ROWS = 16_384
#: Components of this size or more would have distances beyond 64 bits.
LARGEST = 1 << 27

GROUPS, GROUPS_DDL = arrow_schema([("n", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary()), ("entries", pa.binary()), ("sizes", pa.binary())])
SUMS, SUMS_DDL = arrow_schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
NEAREST, NEAREST_DDL = arrow_schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def kept_vectors(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, v)`` of the vectors with all their components, none null or not finite; those without id are none."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    full = rows.filter(F.col("vec_id").isNotNull() & (F.size(v) == dimensions)).filter(F.coalesce(sound, F.lit(False)))
    return full.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def as_integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component reaches {LARGEST // SCALE}: squared distances would leave 64 bits")
    return scaled.astype(np.int64)


def encoded(vectors: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Codes (one row for each block), all dictionaries' entries one after another and their sizes."""
    codes, entries, sizes = [], [], []
    for at in range(0, vectors.shape[1], width):
        block = np.ascontiguousarray(vectors[:, at:at + width])
        distinct, code = np.unique(block, axis=0, return_inverse=True)
        codes.append(code.reshape(-1).astype(np.uint16 if GROUP_ROWS <= 1 << 16 else np.uint32))
        entries.append(distinct.reshape(-1))
        sizes.append(len(distinct))
    return np.stack(codes), np.concatenate(entries), sizes


def encode(rows: DataFrame, dimensions: int = DIMENSIONS, width: int = WIDTH) -> DataFrame:
    """Groups of up to ``GROUP_ROWS`` vectors as codes and dictionaries, one row each."""

    def pack(ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        own, vectors = np.concatenate(ids), np.concatenate(parts)
        codes, entries, sizes = encoded(vectors, width)
        cells = [own.tobytes(), codes.tobytes(), entries.tobytes(), np.array(sizes, np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], schema=GROUPS)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                if ids and held + batch.num_rows > GROUP_ROWS:
                    yield pack(ids, parts)
                    ids, parts, held = [], [], 0
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                ids.append(batch.column("vec_id").to_numpy())
                parts.append(as_integers(values))
                held += batch.num_rows
        if ids:
            yield pack(ids, parts)

    return rows.mapInArrow(group, GROUPS_DDL)


def assigned(codes: np.ndarray, entries: np.ndarray, sizes: list[int], centroids: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (of equals the smallest number) and the squared distance to it, for every vector of a group."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    at = 0
    for number, (code, size) in enumerate(zip(codes, sizes)):
        block = centroids[:, number * width:(number + 1) * width]
        own = entries[at:at + size * block.shape[1]].reshape(size, block.shape[1])
        at += own.size
        partial = np.zeros((size, len(centroids)), np.int64)
        for d in range(block.shape[1]):
            gap = own[:, d, None] - block[None, :, d]
            partial += gap * gap
        total += partial[code]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(total)), nearest]


def opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    for n, ids, codes, entries, sizes in zip(*(batch.column(i) for i in range(5))):
        lengths = np.frombuffer(sizes.as_py(), np.int64).tolist()
        code = np.frombuffer(codes.as_py(), np.uint16 if GROUP_ROWS <= 1 << 16 else np.uint32).reshape(len(lengths), n.as_py())
        yield np.frombuffer(ids.as_py(), np.int64), code, np.frombuffer(entries.as_py(), np.int64), lengths


def cluster_sums(groups: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> dict[int, tuple[int, list[int]]]:
    """How many vectors are nearest to each centroid, and their componentwise sums; a row for each cluster reaches the driver."""
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, codes, entries, sizes in opened(batch):
                nearest, _ = assigned(codes, entries, sizes, centroids, width)
                count += np.bincount(nearest, minlength=k)
                at = 0
                for number, (code, size) in enumerate(zip(codes, sizes)):
                    wide = min(width, dimensions - number * width)
                    own = entries[at:at + size * wide].reshape(size, wide)
                    at += own.size
                    # vectors of one code and cluster are counted before their subvector is summed
                    pairs, times = np.unique(nearest * size + code, return_counts=True)
                    np.add.at(sums, (pairs[:, None] // size, number * width + np.arange(wide)), own[pairs % size] * times[:, None])
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.array(count[full], pa.int64()), pa.array(sums[full].tolist(), pa.list_(pa.int64())),
        ], schema=SUMS)

    parts = groups.mapInArrow(add, SUMS_DDL)
    # sums are kept in 128 bits and more: no number of vectors lets them overflow
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect()
    return {r.cluster: (r.n, [int(r[f"s{i}"]) for i in range(dimensions)]) for r in rows}


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; of repeated ids the smallest vectors."""
    first = kept.orderBy(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), "v").limit(clusters).collect()
    return as_integers(np.array([r.v for r in first], np.float64).reshape(len(first), dimensions))


def fit(kept: DataFrame, groups: DataFrame, clusters: int, rounds: int, dimensions: int, width: int) -> np.ndarray:
    """The centroids after the given number of rounds; a centroid without vectors stays where it is."""
    centroids = first_centroids(kept, clusters, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for cluster, (n, sums) in cluster_sums(groups, centroids, width).items():
            moved[cluster] = [s // n for s in sums]
        centroids = moved
    return centroids


def nearest_centroids(groups: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every encoded vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes, entries, sizes in opened(batch):
                cluster, distance = assigned(codes, entries, sizes, centroids, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=NEAREST)

    return groups.mapInArrow(assign, NEAREST_DDL)


def named(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, width: int = WIDTH) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector of ``rows``.

    A vector counts if it has ``dimensions`` components, none null or not finite, and an id; a component x becomes
    floor(256 * x). Fewer vectors than ``clusters`` give as many centroids, equal vectors go to the centroid of the smallest
    number, repeated rows are rows of their own, and no vectors give no rows. Other columns are not read. Components of 2^19 or
    more raise an error, since their distances do not fit 64 bits. The driver holds the centroids and one sum for each.
    """
    kept = kept_vectors(rows, dimensions)
    groups = landed(encode(kept, dimensions, width), "groups")
    centroids = fit(kept, groups, clusters, rounds, dimensions, width)
    found = landed(nearest_centroids(groups, centroids, width), "nearest")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of_cluster = F.col("cluster")

    def looked_up(values: list, kind: str) -> Column:
        return F.get(F.lit(values).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>"), of_cluster)

    return found.select(
        "vec_id", "cluster", "distance",
        looked_up([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        looked_up([named(c) for c in centroids], "string").alias("centroid_sha256"),
    )
