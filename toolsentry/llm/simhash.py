"""SimHash fingerprints linked by covering locality-sensitive hashing.

The bit positions are given the non-zero vectors of three bits in turn. Mask ``v`` keeps the positions whose vector
has an odd product with ``v``; there are seven masks. Two differing positions are two equations in three
unknowns, so some mask drops both: every pair within two bits agrees under some mask (Pagh, Locality-sensitive Hashing
without False Negatives, 2016). Fingerprints that agree with another one under a mask are looked at there only: each
is paired with the values one free bit away, and two fingerprints at two bits or less share such a value. Such a value
has as many neighbours as there are bits at most, so no group grows, whatever the number of candidates under a mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.arrays import flat, slices, words
from toolsentry.llm.components import components
from toolsentry.llm.repeats import SPACE
from toolsentry.llm.tables import arrow_schema, landed, texts

SHINGLE, SEED, RADIUS = 3, 42, 2
PRINTS, PRINTS_DDL = arrow_schema([("doc_id", pa.int64()), ("bits", pa.int64())])


def fingerprint(content: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int) -> int:
    """Of words that one space separates; a bit is set if it is set in over half the shingle hashes."""
    count = max(1, len(starts) - shingle + 1)
    last = ends[min(shingle, len(ends)) - 1:][:count]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(content[a:b], SEED) for a, b in zip(starts[:count].tolist(), last.tolist())), np.uint64, count)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, bits)`` of whole texts: A-Z lower-cased, words separated by white space, shingles with repeats;
    of fewer words the whole sequence is one shingle, without words the fingerprint is zero."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for text in part.column("text").cast(pa.large_binary()):
                content = b" ".join(text.as_py().lower().split())
                data = np.frombuffer(content, np.uint8)
                starts, ends, _ = words(data, np.array([0, len(data)]), SPACE)
                found.append(fingerprint(content, starts, ends, shingle) if len(starts) else 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int64())], schema=PRINTS)

    return texts(docs).mapInArrow(make, PRINTS_DDL)


def masks() -> list[int]:
    """The seven masks for a radius of two, as signed 64-bit numbers."""
    vectors = [1 + i % 7 for i in range(64)]
    kept = [sum(1 << i for i, v in enumerate(vectors) if (v & m).bit_count() % 2) for m in range(1, 8)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)`` between distinct fingerprints: stars that connect all pairs within two bits, and no others."""
    table = F.explode(F.array([F.struct(F.lit(i).alias("mask"), F.col("bits").bitwiseAND(F.lit(m)).alias("agreed")) for i, m in enumerate(masks())]))
    dealt = prints.select("bits", table.alias("t")).select("bits", "t.*")
    crowded = dealt.groupBy("mask", "agreed").agg(F.count("*").alias("n")).filter("n > 1")
    near = dealt.join(crowded.select("mask", "agreed"), ["mask", "agreed"])
    free = [[0, *(1 << i if i < 63 else -(1 << 63) for i in range(64) if not (m >> i) & 1)] for m in masks()]
    flips = F.element_at(F.array([F.array([F.lit(x).cast("bigint") for x in f]) for f in free]), F.col("mask") + 1)
    centres = near.select("bits", F.explode(flips).alias("flip")).select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("centre"))
    stars = centres.groupBy("centre").agg(F.collect_set("bits").alias("all")).filter(F.size("all") > 1)
    return stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Documents whose fingerprints differ in two bits or less are linked; ``component_id`` is the smallest ``doc_id`` that
    links reach. Null, empty and blank texts have fingerprint zero and are linked like any other.
    """
    prints = landed(fingerprints(docs, shingle), "prints")
    classes = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("bits")))
    member = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    group = F.coalesce("component", "bits")
    least = member.groupBy(group.alias("group")).agg(F.min("first").alias("component_id"))
    of_class = member.select("bits", group.alias("group")).join(least, "group").select("bits", "component_id")
    named = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return prints.join(of_class, "bits").select("doc_id", named.alias("fingerprint"), "component_id")
