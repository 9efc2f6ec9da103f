"""Python sinks (D3): call facts from the syntax tree, verdicts as relational rules.

A syntax tree is the one thing Spark cannot make, so a small Arrow-batched function turns a
file into call rows; which calls matter is decided afterwards in the plan.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import sql
from toolsentry.functions.text import is_build_path, is_test_path
from toolsentry.operators.line_scan import sink_hit, sink_struct
from toolsentry.schemas import CALL_SITES

ADVICE = "Pass an argument list without a shell and validate every input that reaches the command."
_COLUMNS = [field.split()[0] for field in CALL_SITES.split(", ")]
_NAMES = frozenset(fv.PY_EVAL_CALLS) | {func for _, func in fv.PY_SHELL_CALLS}


def _shape(argument: ast.expr | None) -> str | None:
    """How the first positional argument is made."""
    match argument:
        case None:
            return None
        case ast.JoinedStr(values=values):
            return "fstring" if any(isinstance(v, ast.FormattedValue) for v in values) else "literal"
        case ast.BinOp(op=ast.Add() | ast.Mod()):
            return "binop"
        case ast.Call(func=ast.Attribute(attr="format" | "join")):
            return "format"
        case ast.Name():
            return "name"
        case ast.Constant():
            return "literal"
    return "other"


def _call_rows(content: str) -> Iterator[tuple]:
    for node in ast.walk(ast.parse(content)):
        match node:
            case ast.Call(func=ast.Attribute(value=ast.Name(id=module), attr=func)):
                pass
            case ast.Call(func=ast.Name(id=func)):
                module = None
            case _:
                continue
        if func in _NAMES:
            shell = any(
                k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
                for k in node.keywords
            )
            yield node.lineno, module, func, _shape(node.args[0] if node.args else None), shell


def _problem(content: str) -> str | None:
    """Why a file can't be parsed."""
    try:
        ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return type(problem).__name__
    return None


def _problems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        errors = batch.content.map(_problem)
        yield batch[["target", "path"]].assign(error=errors)[errors.notna()]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for target, path, location, content in zip(batch.target, batch.path, batch.location, batch.content):
            try:
                found = list(_call_rows(content))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue  # listed by unparsed_sources
            rows += [(target, path, location, *row) for row in found]
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"line_no": "Int32", "shell_true": "boolean"})


def call_sites(files: DataFrame) -> DataFrame:
    """Calls of possible sinks in Python sources that can be parsed.

    Files that name no sink never reach Python. Identifiers may be spelled with compatibility
    characters, so that test only excludes files that are plain ASCII.
    """
    content = F.col("content")
    names_sink = F.expr(sql.contains_any("content", sorted(_NAMES))) | (F.length(content) != F.octet_length(content))
    return (
        files.filter((F.col("role") == "source") & (F.col("ext") == ".py") & content.isNotNull() & names_sink)
        .select("target", "path", "location", "content")
        .mapInPandas(_extract, CALL_SITES)
    )


def _python_sink() -> str:
    """``struct<what, severity>`` of a call with a dynamic first argument to a known sink."""
    qualified = "concat(module, '.', func)"
    known = f"array_contains({sql.array([f'{m}.{f}' for m, f in fv.PY_SHELL_CALLS])}, {qualified})"
    bare = f"module IS NULL AND array_contains({sql.array(fv.PY_EVAL_CALLS)}, func)"
    return (
        "CASE WHEN coalesce(arg_shape, '') NOT IN ('fstring', 'binop', 'format', 'name') THEN NULL "
        f"WHEN {bare} THEN {sink_struct(sql.concat('func', sql.quoted(fv.EV_DYNAMIC_EXPRESSION)), fv.HIGH)} "
        f"WHEN {qualified} = 'os.system' THEN {sink_struct(sql.quoted(fv.EV_OS_SYSTEM), fv.HIGH)} "
        f"WHEN {known} AND shell_true THEN {sink_struct(sql.concat(qualified, sql.quoted(fv.EV_SHELL_TRUE)), fv.HIGH)} "
        f"WHEN {qualified} = 'os.popen' THEN {sink_struct(sql.quoted(fv.EV_OS_POPEN), fv.MEDIUM)} END"
    )


def python_sink_findings(files: DataFrame) -> DataFrame:
    judged = (
        call_sites(files)
        .withColumn("sink", F.expr(_python_sink()))
        .filter(F.col("sink").isNotNull())
        .withColumn("demoted", is_test_path(F.col("path")) | is_build_path(F.col("path")))
    )
    location = F.concat(F.col("location"), F.lit(":"), F.col("line_no").cast("string"))
    found = sink_hit("sink", "'medium'", "demoted", ADVICE)
    return judged.select("target", location.alias("location"), F.inline(F.expr(f"array({found})")))


def unparsed_sources(files: DataFrame) -> DataFrame:
    """``(target, path, error)`` of every Python file that can't be parsed, whatever it names: the audit skips
    such files but does not hide them."""
    sources = files.filter((F.col("role") == "source") & (F.col("ext") == ".py") & F.col("content").isNotNull())
    return sources.select("target", "path", "content").mapInPandas(_problems, "target STRING, path STRING, error STRING")
