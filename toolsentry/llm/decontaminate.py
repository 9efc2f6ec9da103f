"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences.

Words (lower-case letters, digits and characters beyond ASCII) fall into ``FEATURES`` hash buckets. A bucket's weight is its
inverse frequency among all passages of all documents. A randomised SVD of the benchmark's TF-IDF passages, whose products
with the test matrix are summed by Spark, gives the latent space (Halko, Martinsson and Tropp, Finding Structure with
Randomness, 2011). Every ``RANK`` passages of items have a space of their own with as many directions, so an item of a large
benchmark keeps its energy as one of a small benchmark does. Items of more than ``PASSAGE`` words are split into passages, each with a vector. Windows of 8 to 64
words, as long as the passages asked for, begin at every half of their length, and those whose cosine with a passage
reaches ``COSINE`` are candidates for its item. A candidate is a leak if some ``SPAN`` lengths of the item in its surroundings
have a longest common subsequence with the item that holds enough of the item's words, and enough of its answer, the
item's last sentence, is there in order. A span's length does not depend on the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.llm.arrays import LETTERS, byte_prefix, flat, mixed, slices, span_hash, words
from toolsentry.llm.tables import arrow_schema, texts

FEATURES, RANK, OVERSAMPLE, POWER = 1 << 18, 256, 32, 2
BLOCK, SCALES, PASSAGE = 8, (2, 4, 8), 64
COSINE, LCS_SHARE, ANSWER_SHARE = 0.3, 0.6, 0.5
SPAN = 2
ITEMS_AT_ONCE = 4096
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()),
    ("first_word", pa.int64()), ("n_words", pa.int64()),
])
COUNTS, COUNTS_DDL = arrow_schema([("bucket", pa.int32()), ("n", pa.int64())])
SUMS, SUMS_DDL = arrow_schema([("a", pa.int32()), ("b", pa.int32()), ("v", pa.float64())])


class Space(NamedTuple):
    """Weights of all buckets, the buckets that have coordinates, and their coordinates."""

    weights: np.ndarray
    buckets: np.ndarray
    axes: np.ndarray


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the n + 1 places where texts' words begin."""
    data, bounds = flat(pc.utf8_lower(column))
    starts, ends, places = words(data, bounds, LETTERS)
    return span_hash(byte_prefix(data), starts, ends), places


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FEATURES)).astype(np.int64)


def weights(docs: DataFrame) -> np.ndarray:
    """Inverse passage frequencies over all documents: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(FEATURES, np.int64), 0
        for part in slices(batches):
            hashes, places = hashed_words(part.column("text"))
            sizes = np.diff(places)
            blocks = -(-sizes // PASSAGE)
            first = np.cumsum(blocks) - blocks
            passages += int(blocks.sum())
            # a row for each passage, filled up with a bucket that there is not; a passage counts a bucket once
            held = np.full(int(blocks.sum()) * PASSAGE, FEATURES, np.int32)
            held[np.arange(len(hashes)) + np.repeat(first * PASSAGE - places[:-1], sizes)] = bucket_of(hashes)
            held = np.sort(held.reshape(-1, PASSAGE), axis=1)
            new = np.ones(held.shape, bool)
            new[:, 1:] = held[:, 1:] != held[:, :-1]
            total += np.bincount(held[new], minlength=FEATURES + 1)[:FEATURES]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], passages))], schema=COUNTS)

    rows = docs.select("text").mapInArrow(count, COUNTS_DDL).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    found = np.zeros(FEATURES)
    found[buckets[buckets >= 0]] = n[buckets >= 0]
    return np.log((1 + n[buckets < 0].sum()) / (1 + found)) + 1e-3


def _test_matrix(buckets: np.ndarray, width: int) -> np.ndarray:
    """Rows of a Gaussian matrix that any task can make for itself."""
    seeds = buckets.astype(np.uint64)[:, None] * np.uint64(4 * width) + np.arange(width, dtype=np.uint64)
    u, v = ((mixed(seeds * np.uint64(2) + np.uint64(i)) >> np.uint64(11)) / 2.0**53 for i in (0, 1))
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)


def vectors(column: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of whole texts as rows, buckets and values, each text of length one."""
    hashes, places = hashed_words(column)
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))
    cells, tf = np.unique(row * FEATURES + bucket_of(hashes), return_counts=True)
    row, bucket = cells // FEATURES, cells % FEATURES
    value = tf * weight[bucket]
    norm = np.sqrt(np.bincount(row, value * value, len(places) - 1))
    return row, bucket, value / np.maximum(norm[row], 1e-12)


def latent_space(items: DataFrame, weight: np.ndarray, rank: int = RANK) -> Space:
    """The leading right singular vectors of the items' TF-IDF matrix, from sums over partitions of fixed size."""
    width = rank + OVERSAMPLE

    def summed(of: object, gram: bool) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                row, bucket, value = vectors(part.column("text"), weight)
                own, at = np.unique(bucket, return_inverse=True)
                known = _test_matrix(own, width) if of is None else of[1][np.minimum(np.searchsorted(of[0], own), len(of[0]) - 1)]
                y = np.zeros((part.num_rows, known.shape[1]))
                np.add.at(y, row, known[at] * value[:, None])
                if gram:
                    z, names = y.T @ y, np.arange(y.shape[1])
                else:
                    z, names = np.zeros((len(own), y.shape[1])), own
                    np.add.at(z, at, y[row] * value[:, None])
                a = np.repeat(names, z.shape[1])
                b = np.tile(np.arange(z.shape[1]), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(z.ravel())], schema=SUMS)

        rows = items.select("text").mapInArrow(add, SUMS_DDL).groupBy("a", "b").agg(F.sum("v").alias("v")).toArrow()
        a, b, v = (rows.column(c).to_numpy() for c in ("a", "b", "v"))
        names, at = np.unique(a, return_inverse=True)
        made = np.zeros((len(names), int(b.max(initial=-1)) + 1))
        made[at, b] = v
        return names.astype(np.int64), made

    basis = None
    for _ in range(POWER):
        names, z = summed(basis, gram=False)
        if not len(names):
            return Space(weight, np.zeros(0, np.int64), np.zeros((0, 1), np.float32))
        basis = names, np.linalg.qr(z)[0]
    values, rotation = np.linalg.eigh(summed(basis, gram=True)[1])
    best = [i for i in np.argsort(values)[::-1][:rank] if values[i] > 1e-9 * values[-1]]
    return Space(weight, basis[0], (basis[1] @ rotation[:, best]).astype(np.float32))


def common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, with one bit for each word of ``a``."""
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        met = places.get(word)
        if met is not None:
            shared = row & met
            row = (row + shared | row - shared) & full
    return len(a) - row.bit_count()


class Item(NamedTuple):
    item_id: int
    words: list[int]
    answer: list[int]


def answer_words(text: str) -> str:
    """The item's last sentence or line: the part that answers what comes before."""
    lines = [s for line in text.split("\n") for s in line.split(". ") if any(c.isalnum() for c in s)]
    return lines[-1] if lines else ""


def items_of(rows: list) -> list[Item]:
    """Items with their words and their answers'."""
    hashes, places = hashed_words(pa.array([r.text or "" for r in rows], pa.large_string()))
    answers, answer_places = hashed_words(pa.array([answer_words(r.text or "") for r in rows], pa.large_string()))
    return [Item(r.item_id, hashes[places[i]:places[i + 1]].tolist(), answers[answer_places[i]:answer_places[i + 1]].tolist()) for i, r in enumerate(rows)]


def prepared(rows: list, space: Space) -> tuple[list[Item], np.ndarray]:
    """Items, and their unit vectors in the latent space. Items without words match nothing."""
    items = items_of(rows)
    column = pa.array([r.text or "" for r in rows], pa.large_string())
    row, bucket, value = vectors(column, space.weights)
    at = np.minimum(np.searchsorted(space.buckets, bucket), max(0, len(space.buckets) - 1))
    held = space.buckets[at] == bucket if len(space.buckets) else np.zeros(len(bucket), bool)
    made = np.zeros((len(rows), space.axes.shape[1]), np.float32)
    np.add.at(made, row[held], space.axes[at[held]] * value[held, None].astype(np.float32))
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    return items, made / np.maximum(norm, 1e-12)


class Passage(NamedTuple):
    """A part of an item: the item's number, its words between spaces, and how many they are."""

    item_id: int
    text: str
    size: int


class Group(NamedTuple):
    """Passages that share a space: each one's item, the space, what each known bucket adds to the product with each of
    them (its weighted axes times their directions), and the windows' scales."""

    items: np.ndarray
    space: Space
    products: np.ndarray
    scales: list[int]


def passages(rows: list) -> list[Passage]:
    """Items in even parts of at most ``PASSAGE`` words, the shortest first. Words are those of ``hashed_words``."""
    made = []
    for number, row in enumerate(rows):
        parts = _WORD.findall(row.text or "")
        count = -(-len(parts) // PASSAGE)
        edges = [len(parts) * k // count for k in range(count + 1)] if count else []
        made += [Passage(number, " ".join(parts[a:b]), b - a) for a, b in zip(edges, edges[1:])]
    return sorted(made, key=lambda p: p.size)


def scales_of(sizes: list[int]) -> list[int]:
    """Blocks of the shortest windows that hold passages of such sizes. One that a block holds may lie across two."""
    fitting = {1 << max(0, (-(-size // BLOCK) - 1).bit_length()) for size in sizes}
    return sorted(fitting | ({2} if 1 in fitting else set()))


def groups_of(spark: SparkSession, rows: list, weight: np.ndarray) -> list[Group]:
    """Passages of all items, ``RANK`` at a time."""
    parts, made = passages(rows), []
    for first in range(0, len(parts), RANK):
        some = parts[first:first + RANK]
        space = latent_space(spark.createDataFrame([(p.text,) for p in some], "text string"), weight, len(some))
        if len(space.buckets):
            products = weighted_axes(space) @ prepared(some, space)[1].T
            made.append(Group(np.array([p.item_id for p in some]), space._replace(axes=space.axes[:0]), products, scales_of([p.size for p in some])))
    return made


def weighted_axes(space: Space) -> np.ndarray:
    """Each known bucket's coordinates times its weight, and a row of zeros."""
    rows = space.axes * space.weights[space.buckets, None].astype(np.float32)
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])


def windows(hashes: np.ndarray, places: np.ndarray, space: Space, weighted: np.ndarray, cosine: float, scales: Iterable[int] = SCALES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that may reach the cosine with some item: text, first word, number of words, and the sum of the words' rows
    of ``weighted`` divided by the window's own length in TF-IDF. A text's windows don't depend on the texts beside it."""
    sizes = np.diff(places)
    blocks = -(-sizes // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    text_of = np.repeat(np.arange(len(sizes)), blocks)
    block = np.repeat(first_block, sizes) + (np.arange(len(hashes)) - np.repeat(places[:-1], sizes)) // BLOCK
    bucket = bucket_of(hashes)
    weight = space.weights[bucket]
    at = np.minimum(np.searchsorted(space.buckets, bucket), len(space.buckets) - 1)
    known = space.buckets[at] == bucket
    count = len(text_of)
    energy = np.append(0, np.cumsum(np.bincount(block, weight * weight, count)))
    shared = np.append(0, np.cumsum(np.bincount(block[known], weight[known] ** 2, count)))
    ends = first_block + blocks
    spans = []
    for scale in scales:
        step = max(1, scale // 2)
        each = -(-blocks // step)
        start = np.repeat(first_block, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * step
        # each text has its own grid from its first word on, and a window that ends at its last word
        start = np.append(start, (first_block + np.maximum(blocks - scale, 0))[blocks > 0])
        stop = np.minimum(start + scale, ends[text_of[start]])
        spans.append(np.stack([start, stop], 1))
    start, stop = np.divmod(np.unique(np.concatenate(spans) @ np.array([count + 1, 1])), count + 1)
    own = energy[stop] - energy[start]
    may = shared[stop] - shared[start] >= 0.5 * cosine**2 * own
    start, stop, own = start[may], stop[may], own[may]
    if not len(start):
        return
    # latent sums of the blocks that such windows hold
    marks = np.zeros(count + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, stop, -1)
    used = np.cumsum(marks[:-1]) > 0
    number = np.cumsum(used) - 1
    word = np.flatnonzero(known & used[block])
    # a block's words side by side; places without a known word hold the row of zeros
    held = np.full((int(used.sum()), BLOCK), len(space.buckets))
    held[number[block[word]], (word - places[text_of[block[word]]]) % BLOCK] = at[word]
    latent = np.zeros((len(held), weighted.shape[1]), np.float32)
    # parts of this size stay in a processor's cache
    for a in range(0, len(held), 1 << 9):
        part = latent[a:a + (1 << 9)]
        for place in range(BLOCK):
            part += weighted[held[a:a + (1 << 9), place]]
    sums = np.zeros((len(latent) + 1, latent.shape[1]))
    np.cumsum(latent, axis=0, dtype=np.float64, out=sums[1:])
    for a in range(0, len(start), 1 << 10):
        s, e = start[a:a + (1 << 10)], stop[a:a + (1 << 10)]
        made = (sums[number[s] + e - s] - sums[number[s]]) / np.sqrt(own[a:a + (1 << 10), None])
        text = text_of[s]
        word0 = places[text] + (s - first_block[text]) * BLOCK
        word1 = np.minimum(places[text] + (e - first_block[text]) * BLOCK, places[text + 1])
        yield text, word0, word1 - word0, made


def regions(found: np.ndarray, scores: np.ndarray, places: np.ndarray, asked: list[Item]) -> Iterator[tuple[int, int, int, int, float]]:
    """Text, item, stretch of words and best cosine: windows of one item that lie within its length of each other
    are one stretch, with as many words on either side as the item has."""
    size = np.array([len(item.words) for item in asked])[found[:, 1]]
    start = np.maximum(found[:, 2] - size, places[found[:, 0]])
    stop = np.minimum(found[:, 3] + size, places[found[:, 0] + 1])
    order = np.lexsort((start, found[:, 1], found[:, 0]))
    now: list | None = None
    for t, i, a, b, score in zip(found[order, 0].tolist(), found[order, 1].tolist(), start[order].tolist(), stop[order].tolist(), scores[order].tolist()):
        if now and now[0] == t and now[1] == i and a <= now[3]:
            now[3], now[4] = max(now[3], b), max(now[4], score)
            continue
        if now:
            yield tuple(now)
        now = [t, i, a, b, score]
    if now:
        yield tuple(now)


def confirmed(item: Item, near: np.ndarray, lcs_share: float, answer_share: float) -> Iterator[tuple[float, float, int, int]]:
    """Shares of the item and of its answer in spans of ``near`` that hold enough of both, and where the spans begin and end.

    Spans are ``SPAN`` times as long as the item and begin at every half of its length."""
    size = len(item.words)
    span, step = SPAN * size, max(1, size // 2)
    # other words are in no common subsequence; the answer's words are the item's
    own, counts = np.unique(np.array(item.words, np.uint64), return_counts=True)
    at = np.minimum(np.searchsorted(own, near), len(own) - 1)
    met = np.flatnonzero(own[at] == near)
    starts = np.arange(0, max(1, len(near) - span + step), step)
    first, last = np.searchsorted(met, starts), np.searchsorted(met, starts + span)
    many = np.flatnonzero(last - first >= lcs_share * size)
    if not len(many):
        return
    # no common subsequence holds a word more often than the item or the span does
    bound = np.array([np.minimum(np.bincount(at[met[first[n]:last[n]]], minlength=len(own)), counts).sum() for n in many.tolist()])
    shared = near[met].tolist()
    for n in many[bound / size >= lcs_share].tolist():
        if n and first[n] == first[n - 1] and last[n] == last[n - 1]:
            continue
        words_ = shared[first[n]:last[n]]
        share = common(item.words, words_) / size
        if share < lcs_share:
            continue
        answered = common(item.answer, words_) / len(item.answer) if item.answer else 1.0
        if answered >= answer_share:
            yield share, answered, int(starts[n]), min(int(starts[n]) + span, len(near))


def leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, lcs_share: float = LCS_SHARE, answer_share: float = ANSWER_SHARE) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, first_word, n_words)``: the best place of each item in each document
    that leaks it. Words are counted from 0.

    Items are a stated query set; they are taken in blocks of ``ITEMS_AT_ONCE`` and each block meets all documents.
    Documents without words, items without words and rows without ids match nothing; of repeated items each row counts;
    repeated documents give repeated rows.
    """
    own = texts(docs)
    asked = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    weight = weights(own)
    total = asked.count()
    blocks = max(1, -(-total // ITEMS_AT_ONCE))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = [_of_block(own, dealt.filter(F.col("block") == b).collect(), weight, cosine, lcs_share, answer_share) for b in range(blocks)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _of_block(docs: DataFrame, rows: list, weight: np.ndarray, cosine: float, lcs_share: float, answer_share: float) -> DataFrame:
    asked, groups = items_of(rows), groups_of(docs.sparkSession, rows, weight)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            hashes, places = hashed_words(part.column("text"))
            if not len(hashes):
                continue
            places_, rows_ = [], []
            for group in groups:
                for text, first, size, scores in windows(hashes, places, group.space, group.products, cosine, group.scales):
                    at, i = np.nonzero(scores >= cosine)
                    places_.append(np.stack([text[at], group.items[i], first[at], first[at] + size[at]], 1))
                    rows_.append(scores[at, i])
            if not places_:
                continue
            found, scores = np.concatenate(places_), np.concatenate(rows_)
            best: dict[tuple[int, int], tuple] = {}
            for t, i, a, b, score in regions(found, scores, places, asked):
                for share, answered, start, stop in confirmed(asked[i], hashes[a:b], lcs_share, answer_share):
                    row = (round(share, 4), round(score, 4), round(answered, 4), a + start - int(places[t]), stop - start)
                    if row[:2] > best.get((t, i), (0, 0))[:2]:
                        best[t, i] = row
            keys = sorted(best)
            ids = part.column("doc_id").take(pa.array([t for t, _ in keys], pa.int64()))
            share, score, *rest = list(zip(*(best[k] for k in keys))) or [()] * 5
            columns = [score, share, *rest]
            yield pa.RecordBatch.from_arrays([ids, pa.array([asked[i].item_id for _, i in keys], pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(OUT)[2:]))], schema=OUT)

    return docs.mapInArrow(find, OUT_DDL)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item. Rows without ``doc_id`` stay."""
    named = leaks(docs, items).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(named, docs["doc_id"] == named["_leaking"], "left_anti")
