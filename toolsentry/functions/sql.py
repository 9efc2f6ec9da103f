"""Spark SQL text for expressions that are generated from rules.

Rule packs turn into expressions of hundreds of nodes. Writing them as SQL text hands each
to the JVM in one call; arguments and results here are SQL expressions, not Columns.
"""

from __future__ import annotations

from toolsentry import fixed_values as fv
from toolsentry.functions.regex import SPACE

#: A character outside these ranges, which hold no space but the blank.
_NO_LETTER = r"[^\x20-\x7e\xa1-\u167f\u3001-\x{10ffff}]"


def quoted(text: str) -> str:
    """A string literal. A dollar before a brace is escaped, the parser would substitute it."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{")
    return f"'{escaped}'"


def array(words: list[str]) -> str:
    return "array(" + ", ".join(quoted(w) for w in words) + ")"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{quoted(name)}, {value}" for name, value in fields.items()) + ")"


def concat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def rlike(text: str, pattern: str) -> str:
    """Whether a JVM pattern is found in a text."""
    return f"rlike({text}, {quoted(pattern)})"


def extract(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {quoted(pattern)}, {group})"


def extract_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


def contains_any(text: str, words: list[str]) -> str:
    """Whether a text contains any of the words, tried in the given order."""
    if len(words) == 1:
        return f"contains({text}, {quoted(words[0])})"
    return f"exists({array(words)}, word -> contains({text}, word))"


def folded(text: str) -> str:
    """Upper case, for testing whether a case-insensitive match of an ASCII word is possible.

    Long s and dotless i become their ASCII relatives. Dotted capital I and the Kelvin sign do
    not, so texts with one fold to NULL, which stands for "anything is possible".
    """
    return f"if(contains({text}, '\u0130') OR contains({text}, '\u212a'), NULL, upper({text}))"


def may_contain_any(folded_text: str, words: list[str]) -> str:
    """Whether a folded text may contain any of the (lower-case ASCII) words in any case."""
    return f"coalesce({contains_any(folded_text, [w.upper() for w in words])}, true)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {quoted(f'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '')"


def truncated(text: str, limit: int = fv.EVIDENCE_LIMIT) -> str:
    """Text with collapsed spaces; beyond ``limit`` characters one less and an ellipsis.

    Takes characters, a run of spaces counting as one, until one more than ``limit`` is there
    or the text ends. That fixes the result, so long texts are not rewritten to their end, and
    the beginnings of most texts hold nothing to collapse and are taken as they are.
    """
    enough = f"^[{SPACE}]*((?:[^{SPACE}]|[{SPACE}]+(?=[^{SPACE}])){{0,{limit + 1}}})"
    flat = f"regexp_replace({extract('t', enough, 1)}, {quoted(f'[{SPACE}]+')}, ' ')"
    longer = rf"(?s)^(.{{{limit - 1}}}).{{2,}}\z"
    collapsed = f"regexp_replace({flat}, {quoted(longer)}, '$1…')"
    head = f"left(t, {limit + 1})"
    even = f"NOT (startswith(h, ' ') OR endswith(h, ' ') OR contains(h, '  ') OR {rlike('h', _NO_LETTER)})"
    cut = f"if(char_length(h) > {limit}, concat(left(h, {limit - 1}), '…'), h)"
    # arguments, so that the text and its beginning are made once
    return f"transform(array({text}), t -> transform(array({head}), h -> if({even}, {cut}, {collapsed}))[0])[0]"


def demoted(severity: str) -> str:
    """One severity step down, never below LOW."""
    return f"greatest({fv.LOW}, {severity} - 1)"
