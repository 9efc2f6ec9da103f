"""Exact substring deduplication over words on a compacted De Bruijn graph.

The windows of ``LENGTH`` words are the edges of the graph. Edges that stand side by side and share an anchor are one
path (a run, see ``repeats``). One Spark aggregation finds, for each path, the first document that holds it, and for
each core whether it has a single path (nonbranching: the path is a compacted edge, repeated as a whole or not at
all) or several. Joins bring that back to the source coordinates of all occurrences. Paths that branch are opened
into single edges, and these are joined with their first source again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm import repeats
from toolsentry.llm.tables import arrow_schema, landed, texts

LENGTH, ANCHOR = 50, 12
OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()),
])


def compacted(paths: DataFrame) -> DataFrame:
    """Occurrences of paths that are repeated, or that may be in part: ``(doc_id, key, place, repeated)``.

    Paths are aggregated in each task before they move, so a path with very many occurrences moves few rows.
    """
    nodes = paths.groupBy("core", "span").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    cores = nodes.groupBy("core").agg(F.min("source").alias("first"), F.max("last").alias("last_of_core"), F.count("*").alias("paths"))
    shared = nodes.join(cores.filter("first < last_of_core").select("core", "paths"), "core")
    found = paths.join(shared.select("core", "span", "source", "paths"), ["core", "span"])
    repeated = F.col("source") < F.col("doc_id")
    return found.filter(repeated | (F.col("paths") > 1)).select("doc_id", "key", "place", repeated.alias("repeated"))


def repeated_places(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, key, place)`` of runs of windows that also start in a document with a smaller id."""
    paths = landed(repeats.runs(docs, repeats.words_of, length, anchor), "paths")
    first = landed(compacted(paths), "compacted")
    edges = landed(repeats.windows(docs, first.filter("not repeated"), repeats.words_of, length), "edges")
    sources = edges.groupBy("core", "span").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last")
    again = edges.join(sources, ["core", "span"]).filter("source < doc_id")
    columns = ["doc_id", "key", "place"]
    return first.filter("repeated").select(columns).unionByName(again.select(columns))


def debruijn_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``: every word covered by a window of ``length`` words that also
    starts in a document with a smaller ``doc_id`` is removed; windows are judged on the input.

    Words are separated by white space and compared unchanged; ``kept`` joins the remaining words by one space. Texts of
    fewer words, empty and null ones keep all their words. Rows of one ``doc_id`` never remove each other.
    """
    own = texts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("places")):
                parts = text.as_py().split()
                total, removed = len(parts), 0
                if places.is_valid:
                    starts, ends = repeats.covered(places.values.to_numpy(), length)
                    removed = int((ends - starts).sum())
                    for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist()):
                        del parts[a:b]
                kept = b" ".join(parts)
                rows.append((doc_id, total, removed, repeats.sha256(kept), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)] if rows else [pa.array([], f.type) for f in OUT], schema=OUT)

    return repeats.with_repeats(own, repeated_places(own, length, anchor)).mapInArrow(cut, OUT_DDL)
