"""Long repeated strings of words, and the parts that an operator over bytes shares.

A window is ``LENGTH`` neighbouring symbols of one text. Windows with one anchor (``arrays.anchors``) that
stand side by side form a run; the runs of a text cover all its windows, and there are about eighteen times
fewer runs than windows. A run has two hashes: ``core`` of its anchor, and ``span`` of all the symbols it covers,
polynomials of two bases modulo a prime over hashes of whole words. Equal windows lie in runs of equal cores.

So runs whose core stands in one document only hold no window of another one; a run whose span also starts
in an earlier document is repeated as a whole; what is left are runs of one core and several spans, which
branch somewhere. Those are cut into single windows, whose core covers the same words as their span, and judged again.
Runs are ``(core, span, doc_id, key, place)``; ``place`` packs the first window and the number of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.arrays import anchors, field_hash, field_sums, flat, slices, word_hashes, words
from toolsentry.llm.tables import arrow_schema, text_key

RUN, RUN_DDL = arrow_schema([(n, pa.int64()) for n in ("core", "span", "doc_id", "key", "place")])
COUNT_BITS = 20
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False

Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, which white space separates, and where each text's words begin."""
    starts, ends, places = words(data, bounds, SPACE)
    return word_hashes(data, starts, ends), places


def _rows(core: np.ndarray, spans: np.ndarray, first: np.ndarray, count: np.ndarray, bounds: np.ndarray, batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    text = np.searchsorted(bounds, first, "right") - 1
    span = field_hash(spans, first, first + count + length - 1, 1)
    place = ((first - bounds[text]) << COUNT_BITS) | count
    ids, keys = batch.column("doc_id").to_numpy()[text], batch.column("key").to_numpy()[text]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (core.view(np.int64), span.view(np.int64), ids, keys, place)], schema=RUN)


def runs(docs: DataFrame, symbols: Symbols, length: int, k: int) -> DataFrame:
    """All runs of all texts; ``docs`` has ``doc_id`` and ``text``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashed, bounds = symbols(*flat(part.column("text")))
            if len(hashed) < length:
                continue
            at = np.arange(len(hashed) - k + 1, dtype=np.int64)
            cores = field_hash(field_sums(hashed), at, at + k)
            first, count, where = anchors(cores, bounds, length, k)
            yield _rows(cores[where], field_sums(hashed, 1), first, count, bounds, part, length)

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(make, RUN_DDL)


def windows(docs: DataFrame, open_runs: DataFrame, symbols: Symbols, length: int) -> DataFrame:
    """The single windows of the given runs, as runs of one window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashed, bounds = symbols(*flat(part.column("text")))
            lists = part.column("places")
            places = lists.flatten().to_numpy()
            if not len(places):
                continue
            sums, spans = field_sums(hashed), field_sums(hashed, 1)
            sizes = np.diff(lists.offsets.to_numpy())
            base = np.repeat(bounds[:-1], sizes) + (places >> COUNT_BITS)
            count = places & ((1 << COUNT_BITS) - 1)
            step = np.arange(count.sum(), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(base, count) + step
            for a in range(0, len(first), 1 << 20):
                some = first[a:a + (1 << 20)]
                yield _rows(field_hash(sums, some, some + length), spans, some, np.ones(len(some), np.int64), bounds, part, length)

    own = open_runs.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    return keyed.join(own, ["doc_id", "key"]).mapInArrow(make, RUN_DDL)


def covered(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered stretches of a text whose repeated runs are given."""
    first, count = places >> COUNT_BITS, places & ((1 << COUNT_BITS) - 1)
    order = np.argsort(first, kind="stable")
    first = first[order]
    reach = np.maximum.accumulate(first + count[order] + length - 1)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return first[begin], reach[np.append(begin[1:], len(first)) - 1]


def with_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(doc_id, text, places)``: each document with the places of its repeated runs, or null."""
    own = repeated.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    return keyed.join(own, ["doc_id", "key"], "left").select("doc_id", "text", "places")


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
