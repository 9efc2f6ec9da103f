"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once: the hash's top bits name a bin, the rest compete for the bin's minimum.
Empty bins take the value of a filled one that a sequence of hashes of the bin's number leads to, alike in all documents
(Shrivastava, Optimal Densification for Fast and Accurate Minwise Hashing, 2017). The low eight bits of each bin are
stored; two unrelated bins agree by chance once in 256, and likeness is corrected for that (Li and König, b-Bit
Minwise Hashing, 2010).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.arrays import field_hash, field_sums, flat, mixed, slices, word_hashes, words
from toolsentry.llm.repeats import SPACE
from toolsentry.llm.tables import arrow_schema, texts

BINS, BITS, SHINGLE = 256, 8, 5
PART_IDS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

DEALT, DEALT_DDL = arrow_schema([("part", pa.int64()), ("doc_id", pa.int64()), ("role", pa.int32()), ("text", pa.string())])
OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


@lru_cache(maxsize=4096)
def _donors(attempt: int) -> np.ndarray:
    """The bin that each bin asks in an attempt."""
    return (mixed(np.arange(BINS, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)


def densified(minima: np.ndarray) -> np.ndarray:
    """Rows of bins without empty ones, where a row has a filled bin at all."""
    full, filled = minima.copy(), minima != _EMPTY
    rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    attempt = 0
    while len(rows):
        donor = _donors(attempt) if attempt < 4096 else (np.arange(BINS) + attempt) % BINS
        take = (full[rows] == _EMPTY) & filled[rows][:, donor]
        full[rows] = np.where(take, minima[rows][:, donor], full[rows])
        rows = rows[(full[rows] == _EMPTY).any(axis=1)]
        attempt += 1
    return full


def sketches(contents: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The packed low bits of every bin, one row of bytes for each text; zero for texts without words."""
    data, bounds = flat(contents)
    starts, ends, places = words(data, bounds, SPACE)
    count = np.diff(places)
    sums = field_sums(word_hashes(data, starts, ends))
    each = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(count)), each)
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = places[:-1][text] + step
    hashes = field_hash(sums, first, np.minimum(first + shingle, places[1:][text]))
    minima = np.full(len(count) * BINS, _EMPTY)
    shift = np.uint64(64 - (BINS - 1).bit_length())
    np.minimum.at(minima, text * BINS + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    packed = (mixed(densified(minima.reshape(-1, BINS))) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed[count == 0] = 0
    return packed


def blank(contents: pa.Array) -> np.ndarray:
    """Which texts have no words."""
    data, bounds = flat(contents)
    return np.diff(words(data, bounds, SPACE)[2]) == 0


def likeness(a: np.ndarray, b: np.ndarray, blank_a: np.ndarray, blank_b: np.ndarray) -> np.ndarray:
    """Estimated resemblance of two fingerprints, corrected for bins that agree by chance.

    Two texts without words are alike; a text without words is unlike any other.
    """
    chance = 1 / (1 << BITS)
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(blank_a | blank_b, (blank_a & blank_b).astype(float), found)


def named(packed: np.ndarray, empty: np.ndarray) -> list[str]:
    """Fingerprints as hex digits; texts without words have the empty fingerprint."""
    return ["" if none else row.tobytes().hex() for row, none in zip(packed, empty)]


def splitters(docs: DataFrame, parts: int) -> list[int]:
    """Ids that exist and begin ranges of about equal size, the smallest id first. The sample is bounded by ``parts``."""
    ids = docs.select("doc_id")
    count, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    if not count:
        return []
    every = max(1, count // (parts * PART_IDS))
    sample = sorted({r.doc_id for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).distinct().collect()} | {least})
    step = max(1, -(-len(sample) // parts))
    return sorted({least, *sample[::step]})


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``(part, doc_id, role, text)``: ranges of ids, each sorted, and ending with the text that follows its last one.

    Role 0 is a row of the range, role 1 the first row of the next range (of the first range, after the last one). Only one
    text of each range moves twice.
    """
    begins = splitters(docs, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {b: (i - 1) % len(begins) for i, b in enumerate(begins)}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            part = [bisect.bisect_right(begins, i) - 1 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), batch.column("doc_id"), pa.array([0] * len(ids), pa.int32()), batch.column("text")], schema=DEALT)
            ahead = [row for row, i in enumerate(ids) if i in heads]
            if ahead:
                copied = batch.take(pa.array(ahead))
                yield pa.RecordBatch.from_arrays([
                    pa.array([heads[ids[row]] for row in ahead], pa.int64()), copied.column("doc_id"), pa.array([1] * len(ahead), pa.int32()), copied.column("text"),
                ], schema=DEALT)

    dealt = docs.mapInArrow(deal, DEALT_DDL).repartition(parts, "part")
    return dealt.sortWithinPartitions("part", "role", "doc_id", F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text, or all it has."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the fingerprint of its text and of its text edited with the next document's.

    The next document is the one of the next larger ``doc_id``; rows of one ``doc_id`` follow each other in the order of a
    hash of their texts, and the first follows the last. Shingles have five words separated by white space, unchanged; of
    fewer words the whole sequence is one. Equal texts have equal fingerprints. Null texts are empty.
    """
    own = texts(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(waiting: list[tuple[int, str, str]]) -> pa.RecordBatch:
        ids, own_texts, following = zip(*waiting)
        changed = [edited(a, b) for a, b in zip(own_texts, following)]
        # the following text is the next row's own one, but for the last of a range
        at = [i if i < len(ids) and own_texts[i] is text else -1 for i, text in enumerate(following, 1)]
        others = [text for text, i in zip(following, at) if i < 0]
        place = iter(range(len(ids), len(ids) + len(others)))
        at = [next(place) if i < 0 else i for i in at]
        made = [pa.array(x, pa.large_string()) for x in ([*own_texts, *others], changed)]
        (plain, b), (none, no_b) = map(sketches, made), map(blank, made)
        a, no_a, c, no_c = plain[:len(ids)], none[:len(ids)], plain[at], none[at]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in own_texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(named(a, no_a), pa.string()), pa.array(named(b, no_b), pa.string()),
            pa.array(likeness(a, b, no_a, no_b)), pa.array(likeness(a, c, no_a, no_c)),
        ], schema=OUT)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int, str] | None = None
        waiting: list[tuple[int, str, str]] = []
        size = 0
        for part in slices(batches):
            for bucket, doc_id, role, text in zip(*(part.column(c).to_pylist() for c in ("part", "doc_id", "role", "text"))):
                if before is not None and before[0] == bucket:
                    waiting.append((before[1], before[2], text))
                    size += len(text)
                before = (bucket, doc_id, text) if role == 0 else None
                if size > 1 << 20:
                    yield rows(waiting)
                    waiting, size = [], 0
        if waiting:
            yield rows(waiting)

    return neighbours(own, parts).mapInArrow(make, OUT_DDL)
