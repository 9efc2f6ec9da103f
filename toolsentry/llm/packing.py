"""Best-fit packing of token sequences into bins, planned on lengths.

Bins are planned on how many pieces have each length: that table has as many rows as a bin has places, whatever the
corpus. Pieces longer than a third of a bin pair at most twice per bin, the longest with the longest that still fits;
shorter ones, longest first, each go to the smallest gap that holds them. The plan is a list of runs (so many pieces of one
length go to so many neighbouring bins at one offset); Spark ranks the pieces of each length and looks up their run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from toolsentry.llm.arrays import slices
from toolsentry.llm.tables import arrow_schema, landed, texts
from toolsentry.llm.tokenizing import VOCABULARY, ids_of

CAPACITY, END = 1024, 2
PIECES, PIECES_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])
PLACED, PLACED_DDL = arrow_schema([*((f.name, f.type) for f in PIECES), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, special: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the ids of each whole text and the id ``end``, in pieces of
    ``capacity`` ids; the first piece has what is left over. Null and empty texts are the id ``end`` alone."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(ids_of(text, vocabulary, special), np.uint32(end)).astype("<u4")
                start = 0
                for piece in range(-(-len(ids) // capacity)):
                    stop = start + capacity if piece else (len(ids) - 1) % capacity + 1
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return texts(docs).mapInArrow(make, PIECES_DDL)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, first bin, pieces per bin, offset)`` for so many pieces of each length.

    Piece number r of a run (from 0) goes to bin ``first bin + r // per`` at ``offset + r % per * length``.
    """
    left, ranked = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, ranked[length], n, first, per, offset))
        ranked[length] += n
        left[length] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            mate = next((b for b in large if b <= min(a, capacity - a) and left[b] > (a == b)), None)
            n = left[a] if mate is None else left[a] // 2 if mate == a else min(left[a], left[mate])
            put(a, n, bins, 1, 0)
            if mate is not None:
                put(mate, n, bins, 1, a)
            gaps[capacity - a - (mate or 0)].append((bins, n))
            bins += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if gaps[g]), None)
            if gap is None:
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((bins, n))
                bins += n
                continue
            first, n = gaps[gap].pop()
            per = min(gap // s, left[s])
            used = min(n, left[s] // per)
            put(s, used * per, first, per, capacity - gap)
            gaps[gap - per * s].append((first, used))
            if used < n:
                gaps[gap].append((first + used, n - used))
    return runs


def ranked(rows: DataFrame) -> DataFrame:
    """Pieces with their rank among those of their length. A length may hold most pieces, so each length is counted
    and numbered in as many parts as a shuffle has partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    inner = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = dealt.withColumn("inner", inner).join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("inner") - 1)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of pieces that are no longer than a bin."""
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # runs are sorted by length and first rank: one search over both
            wide = int(runs[:, 1].max(initial=0)) + 1 + int(rank.max(initial=0))
            run = runs[np.searchsorted(runs[:, 0] * wide + runs[:, 1], length * wide + rank, "right") - 1]
            r = rank - run[:, 1]
            sequence, offset = run[:, 3] + r // run[:, 4], run[:, 5] + r % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in PIECES), pa.array(sequence), pa.array(offset)], schema=PLACED)

    return ranked(rows).mapInArrow(place, PLACED_DDL)


def best_fit(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, special: bool = False) -> DataFrame:
    """Whole documents as token pieces, packed into as few sequences of ``capacity`` ids as found.

    Sequences are filled from offset 0 without gaps. Rows without ``doc_id`` are left out; repeated rows are packed each.
    Strings of added tokens are these tokens if ``special``.
    """
    return packed(landed(pieces(docs, capacity, end, vocabulary, special), "pieces"), capacity)
