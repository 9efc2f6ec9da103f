"""Numpy helpers over the UTF-8 bytes of many texts laid one after another.

A batch of texts is one byte array plus the places where each text begins. Spans of that array
are hashed with a polynomial, so that any span's hash follows from two prefix sums: two spans of
equal symbols have equal hashes wherever they stand. ``prefix`` and ``span_hash`` count modulo 2^64,
which is quick but lets texts of two regularly alternating symbols collide; they serve short spans and
features. ``field_sums`` and ``field_hash`` count modulo a prime and decide whether spans are equal.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFF)
_PRIME = np.uint64((1 << 61) - 1)
_FIELD_BASES = (0x0DEADBEE5F1C3A97, 0x1234F00D9B7A6C55)
#: Bytes of letters, digits and characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of batches whose texts have ``limit`` bytes together, or one row if it alone has more."""
    for batch in batches:
        _, bounds = flat(batch.column(column))
        at, rows = 0, batch.num_rows
        while at < rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and pieces they keep add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 places where texts begin and the last ends; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, content = texts.buffers()
    bounds = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``size`` of each; the longest made so far serve all."""
    if which not in _cached or len(_cached[which][0]) < size:
        base, both = _BASES[which], []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _cached[which] = both[0], both[1]
    return _cached[which]


def prefix(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial over symbols (bytes, or 64-bit hashes of words); one more than symbols."""
    size = 1 << max(16, int(len(symbols)).bit_length())
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(which + 1)) * _powers(which, size)[0][:len(symbols)], out=sums[1:])
    return sums


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """As ``prefix``, over bytes, by a table."""
    size = 1 << max(16, int(len(data)).bit_length())
    table = mixed(np.arange(256, dtype=np.uint64) + np.uint64(which + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = table.take(data)
    terms *= _powers(which, size)[0][:len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the symbols that ``sums`` was made of."""
    size = 1 << max(16, int(len(sums) - 1).bit_length())
    raw = (sums[ends] - sums[starts]) * _powers(which, size)[1][starts]
    return mixed(raw + (ends - starts).astype(np.uint64))


def every_hash(sums: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """``span_hash`` of every span of ``size`` symbols, in order."""
    raw = sums[size:] - sums[:-size]
    raw *= _powers(which, 1 << max(16, int(len(sums) - 1).bit_length()))[1][:len(raw)]
    raw += np.uint64(size)
    return mixed(raw)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime 2^61 - 1 of values below it, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return _reduced(ah * bh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + al * bl)


_field_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _field_powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime, at least ``size`` of each."""
    if which not in _field_cached or len(_field_cached[which][0]) < size:
        prime, both = int(_PRIME), []
        for b in (_FIELD_BASES[which], pow(_FIELD_BASES[which], -1, prime)):
            powers = np.ones(1, np.uint64)
            while len(powers) < size:
                powers = np.concatenate([powers, times(powers, np.uint64(pow(b, len(powers), prime)))])
            both.append(powers)
        _field_cached[which] = both[0], both[1]
    return _field_cached[which]


def field_sums(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums modulo the prime of a polynomial over 64-bit symbols; one more than symbols, of which there are below 2^32."""
    terms = times(_reduced(mixed(symbols + np.uint64(which + 1))), _field_powers(which, 1 << max(16, len(symbols).bit_length()))[0][:len(symbols)])
    half, sums = np.uint64(31), np.zeros(len(symbols) + 1, np.uint64)
    high, low = np.cumsum(terms >> half), np.cumsum(terms & np.uint64((1 << 31) - 1))
    sums[1:] = _reduced((high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << half) + _reduced(low))
    return sums


def field_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash (61 bits of it independent) of each span [start, end) of the symbols that ``sums`` was made of."""
    inverse = _field_powers(which, 1 << max(16, (len(sums) - 1).bit_length()))[1]
    raw = times(_reduced(sums[ends] + (_PRIME - sums[starts])), inverse[starts])
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASES[0]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    content, hashed = data.tobytes(), xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(content[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def words(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, runs of bytes that ``in_word`` (256 booleans) allows, and the n + 1 places
    in that list where each text's words begin. Words never cross texts."""
    inside = in_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    finals = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[finals] = inside[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def anchors(hashes: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor.

    ``hashes`` has one hash for each k-symbol string; a window has ``length`` symbols and its
    anchor is its k-symbol string of the smallest hash, the first of equals, so equal windows have
    equal anchors at equal places. Returns for each run of neighbouring windows with one anchor
    the first window, the number of windows and the place of the anchor, in order.
    """
    wide = length - k + 1
    count = len(hashes) - wide + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none
    place = np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & ~_LOW) | (place & _LOW)
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[:count], least[wide - step:wide - step + count])
    where = (least & _LOW).astype(np.int64)
    if len(hashes) > 0x1000000:
        at = np.arange(count, dtype=np.int64)
        where += at & ~np.int64(0xFFFFFF)
        where[where < at] += 0x1000000
    valid = np.zeros(count + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= length:
            valid[a:b - length + 1] = True
    # two texts never share a run: the last windows of a text are not valid
    begin, changed = valid[:count].copy(), where[1:] != where[:-1]
    begin[1:] &= ~valid[:count - 1] | changed
    first = np.flatnonzero(begin)
    stop = ~valid[1:count + 1]
    stop[:-1] |= changed
    last = np.flatnonzero(stop & valid[:count])
    return first, last - first + 1, where[first]
