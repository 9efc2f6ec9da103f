"""Rule packs hold Python ``re`` patterns; Spark evaluates JVM patterns.

The two agree on syntax but not on what ``\\w``, ``\\s``, ``\\d`` and ``\\b`` mean for
non-ASCII text (and the JVM's answer changes between releases), so those shorthands are
replaced by explicit Unicode classes that mean the same everywhere.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The characters of ``SPACE``, one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
_IN_CLASS = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}
_OUTSIDE = {
    "w": f"[{WORD}]", "W": f"[^{WORD}]",
    "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
    "d": r"\p{Nd}", "D": r"\P{Nd}",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    "Z": r"\z",
}
_TOKEN = re.compile(r"\\.|\[\^?\]?|\]|\(\?P<|&&|.", re.DOTALL)


def to_jvm(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    """JVM spelling of a Python pattern, with its flags inlined."""
    out: list[str] = []
    in_class = False
    for token in _TOKEN.findall(pattern):
        if token[0] == "\\":
            table = _IN_CLASS if in_class else _OUTSIDE
            out.append(table.get(token[1], token))
        elif token == "(?P<" and not in_class:
            out.append("(?<")
        elif token[0] == "[" and not in_class:
            in_class = True
            out.append(token[:-1] + r"\]" if token.endswith("]") else token)
        elif in_class and token == "]":
            in_class = False
            out.append(token)
        elif in_class and (token[0] == "[" or token == "&&"):
            out.append("".join("\\" + ch for ch in token))
        else:
            out.append(token)
    flags = ("iu" if ignore_case else "") + ("s" if dot_all else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


def is_valid(pattern: str) -> bool:
    """Whether a rule pattern compiles; packs with a broken rule lose only that rule."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return False
    return True
