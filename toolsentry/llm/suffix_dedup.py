"""Exact substring deduplication over bytes by range-partitioned suffixes.

Documents are dealt into slices of up to 16 megabytes, larger ones where there are more ranges to send to. Only
suffixes that begin a run of windows (``repeats``) are compared; each has a core, the hash of its leading bytes (its anchor), and a span, the hash of all the bytes of its
run. A slice sends every distinct pair of core and span once, with the first document that holds it, so a string with very many
copies moves a pair for each slice. Splitters from a sample of fixed size cut them into ranges; a range sorts its pairs by core,
then span, and compares neighbours:

- a span that an earlier document holds is repeated as a whole;
- a core with several spans branches somewhere behind or before its leading bytes: the first documents of its spans send
  the bytes of their runs, the range sorts all windows in them and answers which ones an earlier document holds.

A core that fills several ranges has a splitter within it. Its pairs are taken as branching on either side of the boundary,
and its windows are sent one by one and ranged by their own hashes, so nothing is lost at a boundary and no range gathers a
whole core. Answers go back to the slices that hold the texts. A slice sends its distinct pairs in an order that follows from the
pairs alone, so an answer names them by their places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm import repeats
from toolsentry.llm.arrays import anchors, byte_prefix, every_hash, flat, give_back, mixed, span_hash
from toolsentry.llm.tables import arrow_schema, texts

LENGTH, LEADING = 50, 16
#: A slice grows with the number of ranges, up to a bound, so that what it sends to one range does not shrink to a few pairs
#: and the rows sent do not grow with the square of the input. Texts are hashed in pieces that stay in a processor's cache.
SLICE_BYTES, SLICE_MOST, ROW_BYTES, RANGE_BYTES, PIECE_BYTES = 1 << 19, 1 << 24, 1 << 12, 8 << 20, 1 << 17
#: The sample that splitters come from has a fixed size: documents, groups that read them and keys of each group. There are
#: at most ``RANGES`` ranges between splitters; ranges of a larger input have ``parts`` by a hash of their cores.
SAMPLE_DOCS, SAMPLE_GROUPS, SAMPLE_KEYS, RANGES = 4096, 16, 4096, 4096

#: ``at`` is the place of a row's first entry among all that the slice sends of a kind; answers name entries by their places.
SENT, SENT_DDL = arrow_schema([("bucket", pa.int32()), ("slice", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
ASKED, ASKED_DDL = arrow_schema([*((f.name, f.type) for f in SENT), ("kind", pa.int32())])
ANSWER, ANSWER_DDL = arrow_schema([("slice", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("content", pa.binary())])
OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("kept", pa.binary()),
])
#: A pair: 48 bits of the core and 16 of the span, then 32 more of the span, then the document's id.
PAIR = np.dtype([("key", "<u8"), ("more", "<u4"), ("doc", "<u2")])
RUN = np.dtype([("doc", "<u2"), ("size", "<u2")])
#: Kinds of questions, each with answers of its own: a code for each pair, or a mask for each run.
PAIRS, SINGLE, PARTS = 0, 1, 2
REPEATED, OPEN = 1, 2
_CORE = np.uint64(0xFFFFFFFFFFFF0000)


def planes(entries: np.ndarray) -> bytes:
    """Entries byte by byte, all first bytes before all second ones: sorted keys share their high bytes, which then
    compress to nearly nothing in a shuffle."""
    return entries.view(np.uint8).reshape(len(entries), -1).T.tobytes()


def entries(raw: np.ndarray, kind: np.dtype) -> np.ndarray:
    """What ``planes`` was made of."""
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def tabled(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def pieces(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of neighbours, given the places where each begins and the last ends, of at most ``PIECE_BYTES`` or one alone."""
    found, at = [], 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE_BYTES, "right")) - 1)
        found.append((at, end))
        at = end
    return found


def steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def windows(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and further bits of the windows of runs that begin at some places."""
    size, found = count + length - 1, []
    for a, z in pieces(np.append(0, np.cumsum(size))):
        n, c = size[a:z], count[a:z]
        content = data[np.repeat(start[a:z], n) + steps(n)]
        first = np.repeat(np.cumsum(n) - n, c) + steps(c)
        key, other = (span_hash(byte_prefix(content, which), first, first + length, which) for which in (0, 1))
        found.append((key, (other >> np.uint64(32)).astype(np.uint32)))
    return tuple(joined(found, np.uint64, np.uint32))


def joined(parts: list[tuple[np.ndarray, ...]], *kinds: type) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, kind) for kind in kinds]


def grouped(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by core, then span, and where in that order a new pair begins."""
    order = np.argsort(key)
    k, m = key[order], more[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    differ = ~new[1:] & (m[1:] != m[:-1])
    if differ.any():
        # most keys have one span: the others alone are sorted by their further bits
        group = np.cumsum(new) - 1
        several = np.zeros(group[-1] + 1, bool)
        several[group[1:][differ]] = True
        at = np.flatnonzero(several[group])
        order[at] = order[at[np.lexsort((m[at], k[at]))]]
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    return order, np.flatnonzero(new)


class Distinct:
    """Distinct pairs in order, whatever the order of the pairs given: each with the first document that holds it. ``of`` has
    the place of each given pair among them, and ``after`` whether an earlier document holds it."""

    def __init__(self, key: np.ndarray, more: np.ndarray, doc: np.ndarray):
        order, begin = grouped(key, more)
        self.key, self.more = key[order[begin]], more[order[begin]]
        self.first = np.minimum.reduceat(doc[order], begin) if len(begin) else doc
        self.of = np.zeros(len(key), np.int64)
        self.of[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        self.after = doc > self.first[self.of]


class Slice:
    """The runs of the texts of a slice, and their distinct pairs."""

    def __init__(self, table: pa.Table, length: int, leading: int):
        give_back()
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        column = table.column("text")
        self.data, self.bounds = flat(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        self.length, self.leading = length, leading
        found = [self._runs(a, z) for a, z in pieces(self.bounds) if self.bounds[z] - self.bounds[a] >= length]
        self.first, self.count, self.text, self.key, self.more = joined(found, np.int64, np.int64, np.int64, np.uint64, np.uint32)

    def _runs(self, a: int, z: int) -> tuple[np.ndarray, ...]:
        start, end = self.bounds[a], self.bounds[z]
        sums, bounds = byte_prefix(self.data[start:end]), self.bounds[a:z + 1] - start
        hashes = every_hash(sums, self.leading)
        first, count, where = anchors(hashes, bounds, self.length, self.leading)
        spans = span_hash(sums, first, first + count + self.length - 1)
        key, more = (hashes[where] & _CORE) | (spans >> np.uint64(48)), (spans & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return first + start, count, np.searchsorted(bounds, first, "right") - 1 + a, key, more

    def pairs(self) -> Distinct:
        return Distinct(self.key, self.more, self.ids[self.text])

    def single(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Distinct]:
        """The windows of some runs: places, texts and their pairs."""
        count = self.count[runs]
        first, text = np.repeat(self.first[runs], count) + steps(count), np.repeat(self.text[runs], count)
        return first, text, Distinct(*windows(self.data, self.first[runs], count, self.length), self.ids[text])


def by_range(bucket: np.ndarray, parts: int) -> np.ndarray:
    """The order in which a slice sends pairs: that of their ranges. Without parts, pairs in order are in order of ranges."""
    return np.arange(len(bucket)) if parts == 1 else np.argsort(bucket, kind="stable")


def stretches(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Each range of an ordered list with the places of its rows, each of 65,536 entries at most."""
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist() if len(bucket) else []
    return [(int(bucket[a]), c, min(z, c + (1 << 16))) for a, z in zip(edges, edges[1:]) for c in range(a, z, 1 << 16)]


def sent(found: Distinct, splitters: np.ndarray, parts: int, number: int) -> pa.Table:
    """Distinct pairs with their first documents, one row for each range that they fall into.

    ``content`` has the ids of the documents named, then the pairs, whose documents are places in those ids.
    """
    bucket = ranged(found.key, splitters, parts)
    order = by_range(bucket, parts)
    key, more, first = found.key[order], found.more[order], found.first[order]
    rows = []
    for b, a, z in stretches(bucket[order]):
        named, at = np.unique(first[a:z], return_inverse=True)
        pairs = np.empty(z - a, PAIR)
        pairs["key"], pairs["more"], pairs["doc"] = key[a:z], more[a:z], at
        rows.append((b, number, a, len(named), named.astype("<i8").tobytes() + planes(pairs)))
    return tabled(rows, SENT)


def sent_runs(part: Slice, found: Distinct, open_: np.ndarray, run: np.ndarray, splitters: np.ndarray, parts: int, number: int) -> pa.Table:
    """One run of each open pair with all its bytes, one row for each range of cores."""
    bucket = ranged(found.key[open_] & _CORE, splitters, parts)
    order = by_range(bucket, parts)
    run, doc = run[order], found.first[open_[order]]
    size = part.count[run] + part.length - 1
    rows = []
    for b, a, z in stretches(bucket[order]):
        named, at = np.unique(doc[a:z], return_inverse=True)
        heads = np.empty(z - a, RUN)
        heads["doc"], heads["size"] = at, size[a:z]
        places = np.repeat(part.first[run[a:z]], size[a:z]) + steps(size[a:z])
        content = named.astype("<i8").tobytes() + np.int64(z - a).tobytes() + heads.tobytes() + part.data[places].tobytes()
        rows.append((b, number, a, len(named), content))
    return tabled(rows, SENT)


def replied(table: pa.Table, kind: int, told: np.ndarray, ends: np.ndarray) -> pa.Table:
    """What each row of a range is told about its entries; rows with nothing to tell get no answer."""
    rows, start = [], 0
    any_ = np.add.reduceat(told != 0, np.append(0, ends[:-1])) if len(ends) else ends
    for number, at, end, some in zip(table.column("slice").to_pylist(), table.column("at").to_pylist(), ends.tolist(), any_.tolist()):
        if some:
            rows.append((number, kind, at, planes(told[start:end])))
        start = end
    return tabled(rows, ANSWER)


def compare_windows(length: int) -> Callable[[pa.Table], pa.Table]:
    """Compares the windows of all runs of a range; answers each run with a mask of those that an earlier document holds."""

    def of_range(table: pa.Table) -> pa.Table:
        give_back()
        heads, docs, contents = [], [], []
        for n, content in zip(table.column("n").to_pylist(), table.column("content")):
            raw = np.frombuffer(content.as_buffer(), np.uint8)
            count = int(raw[8 * n:8 * n + 8].view("<i8")[0])
            end = 8 * n + 8 + count * RUN.itemsize
            heads.append(raw[8 * n + 8:end].view(RUN))
            docs.append(raw[:8 * n].view("<i8")[heads[-1]["doc"]])
            contents.append(raw[end:])
        ends = np.cumsum([len(h) for h in heads])
        size, doc, data = np.concatenate([h["size"] for h in heads]).astype(np.int64), np.concatenate(docs), np.concatenate(contents)
        count = size - length + 1
        step = steps(count)
        gone = Distinct(*windows(data, np.cumsum(size) - size, count, length), np.repeat(doc, count)).after
        masks = np.bitwise_or.reduceat(np.where(gone, np.uint64(1) << step.astype(np.uint64), np.uint64(0)), np.cumsum(count) - count)
        return replied(table, PARTS, masks, ends)

    return of_range


def compare(splitters: np.ndarray, kind: int) -> Callable[[pa.Table], pa.Table]:
    """Compares the pairs of a range and answers each slice: pairs that an earlier document holds and, for runs, pairs
    that the slice holds first and whose core branches."""

    def of_range(table: pa.Table) -> pa.Table:
        give_back()
        keys, mores, docs = [], [], []
        for n, content in zip(table.column("n").to_pylist(), table.column("content")):
            raw = np.frombuffer(content.as_buffer(), np.uint8)
            named, pairs = raw[:8 * n].view("<i8"), entries(raw[8 * n:], PAIR)
            keys.append(pairs["key"])
            mores.append(pairs["more"])
            docs.append(named[pairs["doc"]])
        ends = np.cumsum([len(k) for k in keys])
        key, more, doc = map(np.concatenate, (keys, mores, docs))
        order, begin = grouped(key, more)
        size = np.diff(np.append(begin, len(key)))
        key, doc = key[order[begin]], doc[order]
        source = np.minimum.reduceat(doc, begin)
        repeated = doc > np.repeat(source, size)
        told = np.where(repeated, np.uint8(REPEATED), np.uint8(0))
        if kind == PAIRS:
            core = key & _CORE
            start = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
            spans = np.diff(np.append(start, len(core)))
            several = np.minimum.reduceat(source, start) < np.maximum.reduceat(np.maximum.reduceat(doc, begin), start)
            cut = np.isin(core[start], splitters & _CORE)
            branches = np.repeat(np.repeat(cut | (several & (spans > 1)), spans), size)
            told[branches & ~repeated] = OPEN
        codes = np.empty(len(told), np.uint8)
        codes[order] = told
        return replied(table, kind, codes, ends)

    return of_range


def answered(answers: pa.Table, kind: int, size: int, what: type) -> np.ndarray:
    """What a slice is told about each of the entries of a kind, in the order in which it sent them."""
    told = np.zeros(size, what)
    own = answers.filter(pc.equal(answers.column("kind"), kind))
    for at, content in zip(own.column("at").to_pylist(), own.column("content")):
        part = entries(np.frombuffer(content.as_buffer(), np.uint8), told.dtype)
        told[at:at + len(part)] = part
    return told


def masked(part: Slice, runs: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of runs that their masks mark: places and texts."""
    some = np.flatnonzero(masks)
    run, bit = np.nonzero((masks[some][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    own = runs[some[run]]
    return part.first[own] + bit, part.text[own]


def sampled_splitters(docs: DataFrame, ranges: int, length: int, leading: int) -> np.ndarray:
    """Keys that cut the pairs into ranges of about equal size. The driver gets less than ``2 * SAMPLE_GROUPS * SAMPLE_KEYS``
    keys, whatever the input, from the runs of about ``SAMPLE_DOCS`` documents."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    schema, ddl = arrow_schema([("key", pa.int64())])

    def pick(table: pa.Table) -> pa.Table:
        keys = np.unique(Slice(table, length, leading).key)
        return pa.Table.from_arrays([pa.array(keys[::max(1, len(keys) // SAMPLE_KEYS)].view(np.int64))], schema=schema)

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    rows = chosen.groupBy(F.pmod(F.xxhash64("text", "doc_id"), F.lit(SAMPLE_GROUPS))).applyInArrow(pick, ddl).toArrow()
    keys = np.sort(rows.column("key").to_numpy().view(np.uint64))
    return np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else np.zeros(0, np.uint64)


def ranged(key: np.ndarray, splitters: np.ndarray, parts: int) -> np.ndarray:
    """The range of each key, and within it the part that a hash of its core names: equal cores of a range stay together."""
    found = np.searchsorted(splitters, key, "right")
    return found if parts == 1 else found * parts + (mixed(key & _CORE) % np.uint64(parts)).astype(np.int64)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, leading: int = LEADING) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: every byte covered by a string of ``length``
    bytes that also starts in a document with a smaller ``doc_id`` is removed; strings are judged on the input.

    Texts shorter than ``length``, empty and null ones keep all they have. Rows of one ``doc_id`` never remove each
    other. ``kept`` holds the remaining bytes, which may end within a character. Sizes and splitters
    are looked up when the plan is built; the rest is one lazy plan.
    """
    own = texts(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, -(-total // RANGE_BYTES))
    slices = max(partitions, -(-total // min(max(SLICE_BYTES, ROW_BYTES * ranges), SLICE_MOST)))
    parts = -(-ranges // RANGES)
    splitters = sampled_splitters(own, -(-ranges // parts), length, leading)
    dealt = own.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)))

    def pairs(table: pa.Table) -> pa.Table:
        return sent(Slice(table, length, leading).pairs(), splitters, parts, table.column("slice")[0].as_py())

    hot = np.unique(splitters & _CORE)

    def in_order(told: np.ndarray, key: np.ndarray) -> np.ndarray:
        """What was told about pairs in the order in which they were sent, in the order of the pairs."""
        order = by_range(ranged(key, splitters, parts), parts)
        found = np.empty_like(told)
        found[order] = told
        return found

    def opened(found: Distinct, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs that are repeated as a whole, open pairs, and open runs of cores that fill several ranges."""
        told = in_order(answered(answers, PAIRS, len(found.key), np.uint8), found.key)
        whole, open_ = found.after | (told == REPEATED)[found.of], np.flatnonzero(told == OPEN)
        cut_ = np.isin(found.key[open_] & _CORE, hot)
        is_hot = np.zeros(len(told), bool)
        is_hot[open_[cut_]] = True
        return whole, open_[~cut_], np.flatnonzero(is_hot[found.of] & ~whole)

    def open_content(table: pa.Table, answers: pa.Table) -> pa.Table:
        """What is open in a slice, from one look at its texts: bytes of runs, and windows of cores that fill several ranges."""
        if not table.num_rows or not answers.num_rows:
            return ASKED.empty_table()
        part, number = Slice(table, length, leading), table.column("slice")[0].as_py()
        found = part.pairs()
        whole, open_, hot_runs = opened(found, answers)
        run, own = np.zeros(len(found.key), np.int64), np.flatnonzero(~whole)
        run[found.of[own]] = own  # runs of one pair and one document have the same bytes: any will do
        asked = [(PARTS, sent_runs(part, found, open_, run[open_], splitters, parts, number)), (SINGLE, sent(part.single(hot_runs)[2], splitters, parts, number))]
        return pa.concat_tables([rows.append_column(ASKED.field("kind"), pa.array([kind] * rows.num_rows, pa.int32())) for kind, rows in asked])

    by_kind = {PARTS: compare_windows(length), SINGLE: compare(splitters, SINGLE)}

    def compare_open(table: pa.Table) -> pa.Table:
        return by_kind[table.column("kind")[0].as_py()](table)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        part = Slice(table, length, leading)
        found = part.pairs()
        whole, open_, hot_runs = opened(found, answers)
        first, text, single = part.single(hot_runs)
        gone = single.after | (in_order(answered(answers, SINGLE, len(single.key), np.uint8), single.key) == REPEATED)[single.of]
        masks = np.zeros(len(found.key), np.uint64)
        masks[open_] = in_order(answered(answers, PARTS, len(open_), np.uint64), found.key[open_] & _CORE)
        runs = np.flatnonzero(~whole)
        inner, inner_text = masked(part, runs, masks[found.of[runs]])
        first, text = np.append(first[gone], inner), np.append(text[gone], inner_text)
        places = np.concatenate([(part.first[whole] << repeats.COUNT_BITS) | part.count[whole], (first << repeats.COUNT_BITS) | 1])
        texts_ = np.concatenate([part.text[whole], text])
        order = np.argsort(texts_, kind="stable")
        places, edges = places[order], np.searchsorted(texts_[order], np.arange(len(part.ids) + 1))
        rows = []
        for i, doc_id in enumerate(part.ids.tolist()):
            a, b = int(part.bounds[i]), int(part.bounds[i + 1])
            keep, at, removed, spans = [], a, 0, 0
            if edges[i] < edges[i + 1]:
                starts, ends = repeats.covered(places[edges[i]:edges[i + 1]], length)
                removed, spans = int((ends - starts).sum()), len(starts)
                for s, e in zip(starts.tolist(), ends.tolist()):
                    keep.append(part.data[at:s].tobytes())
                    at = e
            kept = b"".join([*keep, part.data[at:b].tobytes()])
            rows.append((doc_id, b - a, removed, spans, repeats.sha256(kept), kept))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    by_slice = dealt.groupBy("slice")
    runs = by_slice.applyInArrow(pairs, SENT_DDL).groupBy("bucket").applyInArrow(compare(splitters, PAIRS), ANSWER_DDL)
    to_slice = by_slice.cogroup(runs.groupBy("slice"))
    inner = to_slice.applyInArrow(open_content, ASKED_DDL).groupBy("bucket", "kind").applyInArrow(compare_open, ANSWER_DDL)
    answers = runs.unionByName(inner)
    return by_slice.cogroup(answers.groupBy("slice")).applyInArrow(cut, OUT_DDL)
