"""Scalar text and path expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import sql
from toolsentry.functions.regex import SPACE, to_jvm

# single characters, no ranges: those below 256 then share one lookup table
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

#: Those of them that hold no line feed alone.
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def split_lines(content: Column, rare: Column | None = None) -> Column:
    """Array of lines without their terminators; a trailing terminator opens no new line.

    Most texts have line feeds only and need no pattern; ``rare`` says which have others, if that is known. The parts are an
    argument, so that they are made once.
    """
    if rare is None:
        rare = F.exists(F.expr(sql.array(RARE_BREAKS)), lambda mark: F.contains(content, mark))
    parts = F.when(rare, F.split(content, LINE_BREAK)).otherwise(F.split(content, "\n"))
    whole = F.transform(
        F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    )
    return F.get(whole, F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]+)$", 1))


def path_segments(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def _directories(path: Column) -> Column:
    segments = path_segments(path)
    return F.slice(segments, 1, F.size(segments) - 1)


def is_test_path(path: Column) -> Column:
    """Whether a target-relative path is test, example or documentation code."""
    prefixes, suffixes = sql.array(fv.TEST_SEGMENT_PREFIXES), sql.array(fv.TEST_SEGMENT_SUFFIXES)
    name_prefixes, name_suffixes = sql.array(fv.TEST_FILE_PREFIXES), sql.array(fv.TEST_FILE_SUFFIXES)
    name = F.lower(base_name(path))
    return (
        F.arrays_overlap(_directories(path), F.expr(sql.array(fv.TEST_SEGMENTS)))
        | F.exists(_directories(path), lambda d: _any_edge(d, prefixes, F.startswith) | _any_edge(d, suffixes, F.endswith))
        | _any_edge(name, name_prefixes, F.startswith)
        | _any_edge(name, name_suffixes, F.endswith)
    )


def _any_edge(text: Column, options: str, test) -> Column:
    return F.exists(F.expr(options), lambda option: test(text, option))


def is_build_path(path: Column) -> Column:
    return F.arrays_overlap(_directories(path), F.expr(sql.array(fv.BUILD_SEGMENTS)))


def is_pruned_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.expr(sql.array(fv.PRUNED_DIRS)))


def dependency_name(requirement: Column) -> Column:
    return F.regexp_extract(requirement, to_jvm(fv.DEPENDENCY_NAME, ignore_case=False), 0)


def severity_name(severity: Column) -> Column:
    return F.element_at(F.expr(sql.array(fv.SEVERITY_NAMES)), severity.cast("int") + 1)


def sha256_prefix(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)
