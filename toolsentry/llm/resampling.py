"""Importance resampling towards a target distribution.

Features of a text are its runs of one to three words, hashed into buckets. How much likelier a bucket is in the target
texts than in the corpus is its gain; a document's weight is the sum of the gains of its features, and a draw without
replacement takes the documents of the largest weights after a Gumbel noise that depends on the id alone.

Words come from bytes: one table of 256 lower-cases A-Z and blanks separators, ``bytes.split`` yields the words, and
``zlib.crc32`` chained with the hash of what came before extends a run by one word. Counters sum the buckets of a
task's texts before Spark sums those of all tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.functions.ranking import positioned
from toolsentry.llm.arrays import slices
from toolsentry.llm.tables import arrow_schema, landed, texts

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42:"
#: Bytes of a text whose words are held at a time.
PIECE_BYTES = 1 << 20

#: Digits, letters and bytes beyond ASCII stay, A-Z become a-z, all other bytes become blanks.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

COUNTS, COUNTS_DDL = arrow_schema([("bucket", pa.int64()), ("n", pa.int64())])
WEIGHTS, WEIGHTS_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("n_words", pa.int64()),
])


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The translated text in parts of about ``limit`` bytes that end where words end."""
    blanked = text.translate(TABLE)
    at = 0
    while len(blanked) - at > limit:
        end = blanked.find(b" ", at + limit)
        if end < 0:
            break
        yield blanked[at:end]
        at = end
    yield blanked[at:]


def buckets(text: bytes, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of all runs that end in each part of a text, repeats included."""
    before: list[int] = []  # hashes of the runs of 1 .. LONGEST - 1 words that end just before the part
    for piece in pieces(text, limit):
        words = piece.split()
        if not words:
            continue
        more = [b" " + word for word in words]
        runs = list(map(crc32, words))
        found, last = [runs], [runs[-1]]
        for length in range(1, LONGEST):
            # a run of one word more: what ended before a word, continued by that word
            ahead = [before[length - 1], *runs[:-1]] if len(before) >= length else runs[:-1]
            runs = list(map(crc32, more[len(more) - len(ahead):], ahead))
            found.append(runs)
            if not runs:
                break
            last.append(runs[-1])
        before = last[:LONGEST - 1]
        yield len(words), np.array([h for part in found for h in part], np.uint32) % BUCKETS


def feature_counts(rows: DataFrame) -> list[int]:
    """How many features of all ``text`` (null: none) each bucket holds: one row for each bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, found in buckets(text.as_py() or b""):
                    counter.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())], schema=COUNTS)

    counts = [0] * BUCKETS
    for row in rows.select("text").mapInArrow(count, COUNTS_DDL).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of how much likelier the target holds each bucket, with one added to each count."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus, target)]


def noise(doc_id: int) -> int:
    """A Gumbel variate, in thousandths, that an id always gets."""
    h = int(hashlib.sha256(f"{SEED}{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: list[int]) -> DataFrame:
    """``(doc_id, n_features, weight, score, n_words)`` of every document, given the gain of each bucket."""
    table = np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                features = weight = words = 0
                for n, found in buckets(text.as_py()):
                    words += n
                    features += len(found)
                    weight += int(table[found].sum())
                rows.append((doc_id, features, weight, weight + noise(doc_id), words))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=WEIGHTS)

    return docs.mapInArrow(weigh, WEIGHTS_DDL)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) largest scores are drawn and have a rank from 1
    on, equal scores by smaller ``doc_id``; the rank of all others is null. Null and empty texts have no features and a weight
    of 0; an empty target leaves every bucket its chance of an unseen one. Rows without ``doc_id`` are no documents;
    repeated rows are rows of their own, each counted and each with a place. Other columns are not read. The corpus is read twice,
    for the counts and for the weights; ranks come from ranges of the slim rows, not from one window.
    """
    own = texts(docs)
    # landed, since dealing by ranges reads its rows twice
    rows = landed(weighted(own, gains(feature_counts(own), feature_counts(target))), "weights")
    enough = F.col("n_words") >= least_words
    placed = positioned(rows, [enough.desc(), F.col("score").desc(), F.col("doc_id").asc()], "place")
    drawn = placed.agg(F.count_if(enough)).first()[0] * percent // 100
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return placed.select("doc_id", "n_features", "weight", "score", rank)
