"""Many patterns in one pass over a text each, in Arrow batches.

The JVM looks words up one by one and tries a regex at every place of a text. Scans of many rules ask a faster engine first
which of their patterns a text may match; its answer never misses a match, and the rules decide on the texts it names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that regexes of the JVM take for an i, whatever their case, and the engine used here does not.
_ODD = "[İı]"
#: All letters that are not ASCII and are a letter of ASCII in another case.
_FOLDED = "[İıſ\u212a]"
_OTHER = "[:^ascii:]"
_ANY = "(?s:.)"
_OUTSIDE = {"b": "", "B": "", "s": rf"[\t-\r\x1c-\x20{_OTHER}]", "w": rf"[\w{_OTHER}]", "d": rf"[\d{_OTHER}]", "S": _ANY, "W": _ANY, "D": _ANY}
_IN_CLASS = {"s": rf"\t-\r\x1c-\x20{_OTHER}", "w": rf"\w{_OTHER}", "d": rf"\d{_OTHER}"}
_TOKEN = re.compile(r"\\.|\[\^?\]?|.", re.DOTALL)
#: So many patterns are looked for together first; each of them then in texts that match one alone.
MANY = 5


def words_pattern(words: Collection[str]) -> str:
    """Finds any of the words as they are."""
    return "|".join(re.escape(word) for word in sorted(set(words)))


def loose(pattern: str, ignore_case: bool = True) -> str:
    """A pattern that is found in every text in which a Python pattern without lookaround or ``$`` is; word bounds are left out.

    Classes take in all characters that are not ASCII, negated ones keep them.
    """
    out, in_class, negated = [], False, False
    for token in _TOKEN.findall(pattern):
        if token[0] == "\\":
            table = ({} if negated else _IN_CLASS) if in_class else _OUTSIDE
            out.append(table.get(token[1], token))
            continue
        if token[0] == "[" and not in_class:
            in_class, negated = True, token.startswith("[^")
        elif token == "]":
            in_class = False
        out.append(token)
    loosened = "".join(out)
    return f"(?i:{loosened})|{_ODD}" if ignore_case else loosened


def _search(patterns: list[str]) -> Callable[[pa.Array], pa.Array]:
    def search(texts: pa.Array) -> pa.Array:
        marks = pa.array([0] * len(texts), pa.int64())
        for i, pattern in enumerate(patterns):
            found = pc.match_substring_regex(texts, pattern=pattern).fill_null(False)
            marks = pc.bit_wise_or(marks, pc.shift_left(found.cast(pa.int64()), i))
        return marks

    # a search for all patterns at once takes as long as one of them
    either = "|".join(f"(?:{pattern})" for pattern in patterns)

    def search_some(texts: pa.Array) -> pa.Array:
        held = pc.match_substring_regex(texts, pattern=either).fill_null(False)
        marks = np.zeros(len(texts), np.int64)
        marks[held.to_numpy(zero_copy_only=False)] = search(texts.filter(held)).to_numpy(zero_copy_only=False)
        return pa.array(marks)

    return search if len(patterns) < MANY else search_some


def marks(text: Column, patterns: list[str]) -> Column:
    """A number whose bit ``i`` says whether a text holds a match of pattern ``i``; 0 of NULL."""
    return F.arrow_udf(_search(patterns), "bigint").asNondeterministic()(text)


def _first(patterns: list[str], placed: int) -> Callable[[pa.Array], pa.Array]:
    search = _search(patterns)

    def first(texts: pa.Array) -> pa.Array:
        found = search(texts)
        bits = found.to_numpy(zero_copy_only=False)
        starts = np.ones(len(texts), np.int32)
        wanted = np.flatnonzero(bits & ((1 << placed) - 1))
        if len(wanted):
            near, held = texts.take(pa.array(wanted)), bits[wanted]
            # places are found by bytes, so a question mark stands for each character that is not ASCII
            plain = pa.array([text.encode("ascii", "replace") for text in near.to_pylist()], pa.binary()).cast(pa.string())
            least = np.full(len(wanted), np.iinfo(np.int32).max, np.int32)
            for i, pattern in enumerate(patterns[:placed]):
                holders = np.flatnonzero(held & (1 << i))
                at = pc.find_substring_regex(plain.take(pa.array(holders)), pattern=pattern.replace(_OTHER, "?"))
                least[holders] = np.minimum(least[holders], at.to_numpy(zero_copy_only=False))
            # letters that are an i, s or k of other case to an engine are no letters any more
            least[pc.match_substring_regex(near, pattern=_FOLDED).to_numpy(zero_copy_only=False)] = 0
            starts[wanted] = np.maximum(least, 1)
        return pa.StructArray.from_arrays([found, pa.array(starts, pa.int32())], names=["found", "start"])

    return first


def first_marks(text: Column, patterns: list[str], placed: int) -> Column:
    """``struct<found, start>``: the marks of a text, and the character (from 1) before its first match of the first ``placed``
    patterns (1 where that can't be told). No regex that such a pattern stands for matches anything before, so it need not look there."""
    return F.arrow_udf(_first(patterns, placed), "struct<found:bigint,start:int>").asNondeterministic()(text)


def _lines(pattern: str, other: str | None, breaks: Collection[str]) -> Callable[..., pa.Array]:
    kind = pa.struct([("at", pa.int32()), ("line", pa.string())])
    rare = f"[{''.join(breaks)}]"

    def holds(texts: pa.Array, also: pa.Array | None) -> pa.Array:
        found = pc.match_substring_regex(texts, pattern=pattern)
        return found if other is None else pc.or_(found, pc.and_(also, pc.match_substring_regex(texts, pattern=other)))

    def lines(texts: pa.Array, also: pa.Array | None = None) -> pa.Array:
        opened = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        chosen = texts.take(pa.array(opened))
        broken = pc.match_substring_regex(chosen, pattern=rare)
        if broken.true_count:
            plain = pc.replace_substring(chosen.filter(broken), "\r\n", "\n")
            for mark in breaks:
                plain = pc.replace_substring(plain, mark, "\n")
            chosen = pc.replace_with_mask(chosen, broken, plain)
        parts = pc.split_pattern(chosen, "\n")
        values, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        first = np.searchsorted(owner, np.arange(len(opened)))
        wanted = np.flatnonzero(holds(values, None if also is None else also.take(pa.array(opened[owner]))).to_numpy(zero_copy_only=False))
        kept = pa.StructArray.from_arrays(
            [pa.array((wanted - first[owner[wanted]]).astype(np.int32)), values.take(pa.array(wanted))], fields=list(kind))
        offsets = np.searchsorted(opened[owner[wanted]], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), kept)

    return (lambda texts, also: lines(texts, also)) if other else (lambda texts: lines(texts))


def lines_with(text: Column, pattern: str, breaks: Collection[str], other: tuple[Column, str] | None = None) -> Column:
    """``array<struct<at, line>>``: the lines of a text, with their numbers from 0, that hold a match of a pattern, or of an
    ``other`` one where its condition is true. Lines end at a line feed or at ``breaks``; a NULL text has none.
    """
    given = [text] if other is None else [text, other[0]]
    search = _lines(pattern, other and other[1], list(breaks))
    return F.arrow_udf(search, "array<struct<at:int,line:string>>").asNondeterministic()(*given)


def marked(i: int, column: str = "marks") -> str:
    """Whether a text has mark ``i``, as SQL."""
    return f"({column} & {1 << i}L) <> 0"


def only_where(possible: str, expression: str) -> str:
    """An expression that is computed where a text is marked and NULL elsewhere."""
    return f"CASE WHEN {possible} THEN {expression} END"
