"""License scans: phrases and tags found by one automaton, expressions evaluated by a shunting yard.

A text is lower-cased (A-Z) and taken as words, runs of letters, digits and characters beyond ASCII. One Aho-Corasick
automaton finds every phrase whose words stand consecutively. Where the words of an identifier tag are
found, the expression behind the tag is read from the raw text and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from toolsentry.llm.arrays import slices
from toolsentry.llm.tables import arrow_schema, texts

# The phrases and labels that every scan has.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "zlib license": "zlib",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
# Identifier families, the longest first, and whether they let a work be used without conditions on other works.
FAMILIES = {
    "cc-by-nc": False, "cc-by-sa": False, "cc-by-nd": False, "cc-by": True, "cc0": True, "agpl": False, "lgpl": False,
    "gpl": False, "apache": True, "mit": True, "bsd": True, "isc": True, "mpl": False, "epl": False, "bsl": True,
    "zlib": True, "unlicense": True, "0bsd": True,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TAG_WEIGHT, BASE_WEIGHT, MORE_WEIGHT = 0.95, 0.8, 0.6

OUT, OUT_DDL = arrow_schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()),
    ("permissive", pa.bool_()),
])

_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_TOKEN = re.compile(rb"[()]|[a-z0-9.+:-]+")
_TAG = re.compile(rb"(?:spdx[^a-z0-9\n]*license[^a-z0-9\n]*identifier|license[^a-z0-9\n]*expression)[ \t\x22\x27]*[:=]")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Of phrases between spaces; the value is (kind, label, length)."""
    made = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("more", MORE_PHRASES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    made.make_automaton()
    return made


def family(identifier: str) -> str:
    """The label of a licence identifier; an unknown one is its own label."""
    return next((f for f in FAMILIES if identifier == f or identifier.startswith(f"{f}-")), identifier.rstrip("+"))


def postfix(tokens: list[str]) -> list[str] | None:
    """The shunting yard: operands and operators in the order of evaluation, or None if tokens are no expression.

    An expression that is complete ends at the first token that can't go on with it: a tag's line may hold more text.
    """
    done: list[str] = []
    waiting: list[str] = []
    operand = True
    for token in tokens:
        if token == "(":
            if not operand:
                break
            waiting.append(token)
        elif token == ")":
            if operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                done.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                done.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif operand:
            done.append(token)
            operand = False
        else:
            break
    if operand or "(" in waiting:
        return None
    return done + waiting[::-1]


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """Labels of an expression, and whether one may choose terms without conditions on other works.

    ``or`` leaves the choice, ``and`` binds to both sides, ``with`` adds an exception to its licence."""
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token not in PRECEDENCE:
            label = family(token)
            stack.append(({label}, FAMILIES.get(label, False)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            free = left[1] or right[1] if token == "or" else left[1] and right[1]
            stack.append((left[0] | right[0], free))
    return stack[0]


def expressions(lowered: bytes) -> list[tuple[str, set[str], bool]]:
    """Every well-formed expression behind a tag and its colon (or equals sign): its text in postfix order, labels, and whether it is permissive."""
    found = []
    tags = list(_TAG.finditer(lowered))
    for tag, following in zip(tags, [*tags[1:], None]):
        # up to the next tag or line feed
        stop = following.start() if following else len(lowered)
        feed = lowered.find(b"\n", tag.end(), stop)
        stop = feed if feed >= 0 else stop
        # an operand has a letter or digit: what is only dots and colons is none
        tokens = [t.decode().strip(".:") for t in _TOKEN.findall(lowered, tag.end(), stop)]
        order = postfix([t for t in tokens if t in "()" and t or re.search("[a-z0-9]", t)])
        if order:
            found.append((" ".join(order), *evaluate(order)))
    return found


def scan(text: bytes) -> tuple:
    """One text's row without its id."""
    lowered = text.lower()  # of bytes: A-Z only
    words = lowered.translate(_TABLE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, places, more, tagged = set(), [], set(), False
    for end, (kind, label, length) in automaton().iter(joined):
        if kind == "base":
            base.add(label)
            places.append(end - length + 1)
        elif kind == "more":
            more.add(label)
        else:
            tagged = True
    terms = expressions(lowered) if tagged else []
    named = set().union(*(labels for _, labels, _ in terms))
    starts = [joined.count(" ", 0, at) for at in (min(places), max(places))] if places else [None, None]
    doubt = (1 - TAG_WEIGHT) ** len(named) * (1 - BASE_WEIGHT) ** len(base) * (1 - MORE_WEIGHT) ** len(more)
    return (
        len(words), len(places), *starts, ",".join(sorted(base)), ",".join(sorted(base | more | named)), round(1 - doubt, 6),
        "; ".join(order for order, _, _ in terms), all(free for _, _, free in terms) if terms else None,
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: words, places of base phrases, labels, and expressions behind tags.

    ``n_base`` counts all places, ``first_word`` and ``last_word`` are the smallest and largest start (words from 0; null
    without a place). Labels are distinct, sorted and comma-joined, empty without any. ``score`` is one less the chance
    that every piece of evidence is wrong. Null, empty and blank texts have no words, no labels and score 0. Tags
    with malformed expressions give no labels. Every text is scanned whole.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [scan(text.as_py()) for text in part.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(OUT)[1:]))], schema=OUT)

    return texts(docs).mapInArrow(make, OUT_DDL)
