"""Suppression against very large allowlists: a Bloom filter keeps findings that cannot be listed out of the shuffle.

The filter is a fixed number of bits, made by aggregates and broadcast as one row; it is no part of the plan, whose copies
would fill the driver. It says for each finding whether an entry may name it; only those findings are joined with the
list, all others stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry.operators.findings import suppress

#: One megabyte; of a million entries a foreign finding passes with a chance of 3 in 100.
BITS = 1 << 23
HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    """Where a key's bits are."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _key(target: Column, fingerprint: Column) -> Column:
    """Entries that hold everywhere have a key without target."""
    return F.struct(F.coalesce(target, F.lit("")).alias("target"), fingerprint.alias("fingerprint"))


def bloom_filter(allowlist: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with ``words``, the filter of an allowlist's entries, 64 bits to a word; its size is fixed, whatever the list."""
    places = allowlist.select(F.explode(F.array(*_places(_key(F.col("target"), F.col("fingerprint")), bits))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    masks = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    every = allowlist.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(masks, "word", "left")
    word = F.struct("word", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))
    return every.agg(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["mask"]).alias("words"))


def bloom_words(allowlist: DataFrame, bits: int = BITS) -> list[int]:
    """The filter of an allowlist's entries as numbers, for small filters; ``suppress_large`` keeps them off the driver."""
    return bloom_filter(allowlist, bits).first().words


def may_be_listed(words: list[int] | Column, target: Column, fingerprint: Column, bits: int | None = None) -> Column:
    """False only for findings that no entry, global or of their target, names. ``bits`` is needed where the words are a column."""
    table = words if isinstance(words, Column) else F.lit(words).cast("array<bigint>")
    bits = bits or len(words) * 64

    def within(key: Column) -> Column:
        set_bits = [
            F.call_function("shiftright", F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            for place in _places(key, bits)
        ]
        return reduce(lambda a, b: a & b, set_bits)

    return within(_key(F.lit(None).cast("string"), fingerprint)) | within(_key(target, fingerprint))


def suppress_large(findings: DataFrame, allowlist: DataFrame, bits: int = BITS) -> DataFrame:
    """What ``suppress`` gives, for allowlists that are too long to broadcast.

    The findings are read twice, once for those that may be listed and once for the others, the list for the filter and for
    the join: land both first. The filter alone, one row, is broadcast. A finding without fingerprint is never suppressed.
    """
    entries = allowlist.select("target", "fingerprint").filter(F.col("fingerprint").isNotNull())
    sieve = F.broadcast(bloom_filter(entries, bits).select(F.col("words").alias("_words")))
    listed = F.coalesce(may_be_listed(F.col("_words"), F.col("target"), F.col("fingerprint"), bits), F.lit(False))
    return suppress(findings.join(sieve, listed, "left_semi"), entries).unionByName(findings.join(sieve, listed, "left_anti"))
