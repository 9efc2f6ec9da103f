"""Token counts of fields and sections, from one encoding of the whole document.

The fields of a document are joined and encoded once. Tokens and sections are both intervals of the document's bytes, in
order, so their join is one search of token starts in section starts. A token that lies in several sections is
given out by a rule that is named:

``first``  to the section that holds its first byte;
``most``   to the section that holds most of its bytes, the first of equals;
``split``  to each section by its share of the token's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.arrays import flat, slices
from toolsentry.llm.tables import arrow_schema
from toolsentry.llm.tokenizing import VOCABULARY, encoding, ids_of

RULES = ("first", "most", "split")
JOINER = "\n"
OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()),
    ("n_tokens", pa.float64()), ("n_crossing", pa.int64()),
])


def attributed(token_starts: np.ndarray, token_sizes: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of the tokens touching it cross a border.

    Sections cover all bytes from the first token on; tokens have at least one byte.
    """
    n = len(section_starts)
    first = np.searchsorted(section_starts, token_starts, "right") - 1
    last = np.searchsorted(section_starts, token_starts + token_sizes - 1, "right") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for token in np.flatnonzero(~inside):
        a, b = first[token], last[token]
        edges = np.append(section_starts[a + 1:b + 1], token_starts[token] + token_sizes[token])
        shares = np.diff(edges, prepend=token_starts[token])
        held = np.flatnonzero(shares) + a
        crossing[held] += 1
        if rule == "first":
            counts[a] += 1
        elif rule == "most":
            counts[a + int(np.argmax(shares))] += 1
        else:
            counts[a:b + 1] += shares / token_sizes[token]
    return counts, crossing


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first", vocabulary: str = VOCABULARY, special: bool = False) -> DataFrame:
    """``(doc_id, field, section, start_char, end_char, n_tokens, n_crossing)``: one row for each line of each field.

    Fields are joined by a line feed, which belongs to the field before it; a line's own line feed belongs to it.
    ``start_char`` and ``end_char`` count code points within the field; ``n_tokens`` is whole under ``first`` and
    ``most``, and sums to the document's tokens under every rule. Null and empty fields are one empty section with the
    tokens of their joiner, if any. Rows without ``doc_id`` are left out; repeated rows are counted each.
    Strings of added tokens are these tokens if ``special``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    own = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.array(*[F.length(F.coalesce(F.col(f), F.lit(""))).cast("bigint") for f in fields]).alias("lengths"),
        F.concat_ws(JOINER, *[F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("text"),
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = encoding(vocabulary)[1]
        for part in slices(batches):
            data, bounds = flat(part.column("text"))
            encoded = [ids_of(text, vocabulary, special) for text in part.column("text").to_pylist()]
            widths = sizes[np.concatenate(encoded)]
            token_starts = np.cumsum(widths) - widths
            # code points before each byte
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            feeds = np.flatnonzero(data == 10) + 1
            starts, ends, field_of, begins, rows = [], [], [], [], []
            for row, lengths in enumerate(part.column("lengths").to_pylist()):
                a, b = int(bounds[row]), int(bounds[row + 1])
                lines = feeds[np.searchsorted(feeds, a, "right"):np.searchsorted(feeds, b, "right")]
                begin = int(points[a])
                for number, length in enumerate(lengths):
                    # the byte where the field's last code point has ended
                    stop = int(np.searchsorted(points, begin + length, "right")) - 1
                    at = int(np.searchsorted(points, begin, "right")) - 1
                    inner = lines[(lines > at) & (lines < stop)]
                    starts.append(np.concatenate([[at], inner]))
                    ends.append(np.concatenate([inner, [stop]]))
                    count = len(inner) + 1
                    field_of += [number] * count
                    begins.append(np.full(count, begin))
                    rows.append(np.full(count, row))
                    begin += length + 1
            starts, ends, begins, rows = map(np.concatenate, (starts, ends, begins, rows))
            counts, crossing = attributed(token_starts, widths, starts, rule) if len(widths) else (np.zeros(len(starts)), np.zeros(len(starts), np.int64))
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]) | (begins[1:] != begins[:-1])
            index = np.arange(len(rows))
            section = index - np.maximum.accumulate(np.where(fresh, index, 0))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(rows)), pa.array([fields[f] for f in field_of], pa.string()), pa.array(section, pa.int32()),
                pa.array(points[starts] - begins), pa.array(points[ends] - begins), pa.array(counts), pa.array(crossing),
            ], schema=OUT)

    return own.mapInArrow(make, OUT_DDL)
