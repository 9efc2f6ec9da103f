"""Scans over source lines: credentials (D2) and JavaScript sinks (D3).

Both run in one pass. Files without any of the needed literals are dropped before they are
split, lines without them before any regex runs, and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import regex, sql
from toolsentry.functions.text import RARE_BREAKS, is_build_path, is_test_path, split_lines
from toolsentry.functions.words import lines_with, marked, marks, words_pattern
from toolsentry.operators import secrets
from toolsentry.operators.hits import NO_HITS, collected, hit, placed

D2, D3 = "D2", "D3"
SINK_OWASP_ID = "MCP05"
SINK_TITLE = "Shell or code execution fed by a dynamic value"
JS_ADVICE = "Call execFile or spawn with an argument array, leave the shell option off and validate inputs."

_JS_WORDS = ["exec", "eval", "Function", "spawn"]


def _js(pattern: str, dot_all: bool = False) -> str:
    return regex.to_jvm(pattern, ignore_case=False, dot_all=dot_all)


def sink_struct(what: str, severity: int) -> str:
    return sql.struct(what=what, severity=f"cast({severity} as tinyint)")


def js_sink(line: str, imports_child_process: str) -> str:
    """``struct<what, severity>`` of the first risky sink of a line, or NULL.

    Sinks are tried in the order exec, eval, spawn; one that turns out harmless gives way to
    the next, so a line yields at most one.
    """

    def built(tail: str) -> str:
        return f"({sql.rlike(tail, _js(fv.JS_TEMPLATE_DYNAMIC))} OR {sql.rlike(tail, _js(fv.JS_CONCAT))})"

    def variable(tail: str) -> str:
        return sql.rlike(tail, _js(fv.JS_IDENTIFIER_ARGUMENT))

    exec_call = _js(fv.JS_EXEC_CALL + "(.*)", dot_all=True)
    name, tail = sql.extract(line, exec_call, 1), sql.extract(line, exec_call, 2)
    counts = f"({name} = 'execSync' OR ({name} = 'exec' AND {imports_child_process}))"
    inserted = sql.extract_all(tail, _js(fv.JS_INTERPOLATION), 1)
    stringified = f"size({inserted}) > 0 AND forall({inserted}, i -> startswith(i, {sql.quoted(fv.JS_STRINGIFY)}))"

    def named(sentence: str) -> str:
        return sql.concat(name, sql.quoted(sentence))

    eval_call = _js(fv.JS_EVAL_CALL + "(.*)", dot_all=True)
    eval_name, eval_tail = sql.extract(line, eval_call, 1), sql.extract(line, eval_call, 2)
    spawned = sql.extract(line, _js("(" + fv.JS_SPAWN_SHELL + ".*)", dot_all=True), 1)
    from_exec = (
        f"CASE WHEN contains({line}, 'exec') AND {counts} THEN CASE "
        f"WHEN {built(tail)} AND {stringified} THEN {sink_struct(named(fv.EV_STRINGIFIED), fv.MEDIUM)} "
        f"WHEN {built(tail)} THEN {sink_struct(named(fv.EV_BUILT_COMMAND), fv.HIGH)} "
        f"WHEN {variable(tail)} THEN {sink_struct(named(fv.EV_VARIABLE_COMMAND), fv.MEDIUM)} END END"
    )
    from_eval = (
        f"CASE WHEN {sql.contains_any(line, ['eval', 'Function'])} AND {eval_name} <> '' "
        f"AND ({built(eval_tail)} OR {variable(eval_tail)}) "
        f"THEN {sink_struct(sql.concat(eval_name, sql.quoted(fv.EV_DYNAMIC_EXPRESSION)), fv.HIGH)} END"
    )
    from_spawn = (
        f"CASE WHEN contains({line}, 'spawn') AND contains({line}, 'shell') AND {spawned} <> '' AND {built(spawned)} "
        f"THEN {sink_struct(sql.quoted(fv.EV_SPAWN_SHELL), fv.HIGH)} END"
    )
    return f"coalesce({from_exec}, {from_eval}, {from_spawn})"


def sink_hit(sink: str, confidence: str, demoted: str, advice: str) -> str:
    """The D3 hit of a sink; in test and build code one step lower and marked as such."""
    severity = f"if({demoted}, {sql.demoted(f'{sink}.severity')}, {sink}.severity)"
    what = sql.concat(f"{sink}.what", f"if({demoted}, {sql.quoted(fv.TEST_BUILD_MARK)}, '')")
    return hit(D3, "'D3-CMDINJ'", sql.quoted(SINK_TITLE), severity, SINK_OWASP_ID, confidence, what, advice)


def line_findings(files: DataFrame, detectors: Collection[str] = (D2, D3), sift: bool = False) -> DataFrame:
    """Credential and JavaScript-sink findings of source and config lines.

    With ``sift`` files are searched in Python before anything else looks at them, and so are the lines of those that match.
    """
    in_js = f"(role = 'source' AND array_contains({sql.array(fv.JS_EXTENSIONS)}, ext))"
    in_file, in_line = [], []
    if D2 in detectors:
        in_file.append(secrets.holds_secret("content", "folded"))
        in_line.append(secrets.may_hold_secret("line", "folded"))
    if D3 in detectors:
        in_file.append(f"({in_js} AND {sql.contains_any('content', _JS_WORDS)})")
        in_line.append(f"(scripted AND {sql.contains_any('line', _JS_WORDS)})")

    candidates = files.filter("role IN ('source', 'config')")
    gate, folded = " OR ".join(in_file), sql.folded("content")
    if sift:
        candidates = candidates.withColumn("marks", marks(F.col("content"), [secrets.secret_pattern(), words_pattern(_JS_WORDS)]))
        wanted = ([marked(0)] if D2 in detectors else []) + ([f"({in_js} AND {marked(1)})"] if D3 in detectors else [])
        candidates = candidates.withColumn("scripted", F.expr(in_js)).withColumn("sifted", F.when(F.expr(" OR ".join(wanted)), F.col("content")))
        patterns = ([secrets.secret_pattern()] if D2 in detectors else []) + ([words_pattern(_JS_WORDS)] if D3 in detectors else [])
        scripts = (F.coalesce("scripted", F.lit(False)), patterns[1]) if len(patterns) > 1 else None
        candidates = candidates.withColumn("sifted", lines_with(F.col("sifted"), patterns[0], RARE_BREAKS, scripts))
    elif D2 in detectors:
        candidates = candidates.withColumn("folded", F.expr(folded))
    # The gates sit inside the generators: as filters they would be pushed below the folded
    # text and compute it again for every word they test.
    lines = candidates.select(
        "target",
        "location",
        F.expr(in_js).alias("scripted"),
        F.contains("content", F.lit(fv.JS_CHILD_PROCESS)).alias("imports_child_process"),
        is_test_path(F.col("path")).alias("in_test"),
        is_build_path(F.col("path")).alias("in_build"),
        F.inline("sifted") if sift else F.posexplode(F.when(F.expr(gate), split_lines(F.col("content")))).alias("at", "line"),
    )
    if D2 in detectors:
        lines = lines.withColumn("folded", F.expr(sql.folded("line")))
    hits = [NO_HITS]
    if D2 in detectors:
        hits.append(secrets.secret_hits("line", "folded", "in_test"))
    if D3 in detectors:
        code_line = f"{in_line[-1]} AND NOT {sql.rlike('line', _js(fv.JS_COMMENT_LINE))}"
        sink = f"CASE WHEN {code_line} THEN {js_sink('line', 'imports_child_process')} END"
        lines = lines.withColumn("sink", F.expr(sink))
        confidence = f"if(sink.severity = {fv.HIGH}, 'medium', 'low')"
        found = sink_hit("sink", confidence, "(in_test OR in_build)", JS_ADVICE)
        hits.append(collected([f"CASE WHEN sink IS NOT NULL THEN {found} END"]))
    found = f"CASE WHEN {' OR '.join(in_line)} THEN {sql.concat(*hits)} END"
    location = F.concat(F.col("location"), F.lit(":"), (F.col("at") + 1).cast("string"))
    return lines.select("target", location.alias("location"), F.inline(F.expr(found)))


def config_line_hits(lines: str) -> str:
    """The credential hits of the lines of a config, with their places, in a row with ``location`` and ``in_test``.

    ``lines`` is a SQL expression, NULL where no line needs to be looked at. What ``line_findings`` says about sources' code
    never applies to configs.
    """
    worded = f"transform({lines}, (text, at) -> {sql.struct(text='text', folded=sql.folded('text'), at='at')})"
    found = f"CASE WHEN {secrets.may_hold_secret('l.text', 'l.folded')} THEN {secrets.secret_hits('l.text', 'l.folded', 'in_test')} END"
    place = "concat(location, ':', l.at + 1)"
    of_lines = f"transform({worded}, l -> {placed(found, place)})"
    return f"flatten(array_compact({of_lines}))"


def secret_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, [D2])


def js_sink_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, [D3])
