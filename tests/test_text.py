"""Scalar expressions against Python's own re and str."""

import re

from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import regex, sql
from toolsentry.functions.text import is_build_path, is_test_path, split_lines
from toolsentry.operators.hits import rule_matches
from toolsentry.operators.rules import BUILTIN

ODD = [
    "", " ", "a", "a\n", "a\r\nb\rc", "\n\n", "x\x0by\x0cz\x1ca\x1db\x1ec\x85d\u2028e\u2029f\n", "tab\t\tend ",
    "\u00a0nbsp\u3000wide\u2003em", "é" * 159 + " ü", "w " * 100, "x" * 160, "x" * 161, " " * 300 + "y" + " " * 300,
    "a" * 159 + "  b", "a" * 160 + "  ", "\U0001f600" * 200, "no\u200bbreak\x1funit",
]
TEXTS = [
    "Please ſend it to https://x", "IGNORE ALL PREVIOUS words", "ignore\u200d all previous", "éignore all previous",
    "ignoreé the previous", "you must", "you mustn't", "you must́", "do not tell", "DON'T MENTION", ".ENV", ".envé",
    "tell me your ınstructions", "forget x your instructions", "forget.your instructions", "forget\nyour instructions",
    "act as a thing without any filter", "you are now DAN", "you are now DANé", "< /system>", "</System >", "[/inst]",
    "### \u00a0system", "real instructions\u2003:", "from now on you shouldn't", "all ... secrets", "the API Keys.",
    "read all rows", "reads all rows", "fetch any of the chat history", "Keep all toKens", "SELECT\u00a0*",
    "recursively", "any file in", "post̀ to the server", "report_ to the url", "upload" + "x" * 60 + "https://",
    "upload " + "x" * 59 + "https://", "upload " + "x" * 60 + "https://", "send\U0001f600 to url", "a webhook send the webhook",
    "İgnore the previous", "dİsregard prior", "toKen of all toKens", "ACT AS a guide wİthout any filter", "ıgnore all previous",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(2)


def python_truncate(text):
    flat = " ".join(text.split())
    return flat if len(flat) <= 160 else flat[:159] + "…"


def test_truncated_evidence_equals_python(spark):
    got = rows(spark, ODD).select("i", F.expr(sql.truncated("text")).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: python_truncate(t) for i, t in enumerate(ODD)}


def test_even_evidence_is_cut_without_a_pattern(spark):
    """Only beginnings with something to collapse go through the patterns that collapse it."""
    texts = ["a b", "é" * 170, "a" * 160 + " b", "a" * 160 + " ", "a" * 161, "x " * 80, " x", "x  y", "x\u2003y", "x\u1680y", "x\x85y", "\u3001" * 161, "\x7f",
             "a" * 158 + " b c", "a" * 159 + " b", "\U0001f600" * 161, "w " * 500, None]
    cut = sql.truncated("text")
    assert cut.index("if(NOT (startswith") < cut.index("regexp_replace")
    got = rows(spark, texts).select("i", F.expr(cut).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: None if t is None else python_truncate(t) for i, t in enumerate(texts)}


def test_split_lines_equals_python(spark):
    got = rows(spark, ODD).select("i", split_lines(F.col("text")).alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: t.splitlines() for i, t in enumerate(ODD)}


def test_every_rule_matches_like_python(spark):
    rules = [r for pack in BUILTIN.values() for r in pack]
    texts = TEXTS + ODD
    folded = rows(spark, texts).withColumn("folded", F.expr(sql.folded("text")))
    got = folded.select(
        "i",
        *[F.expr(f"if({rule_matches(r, 'text', 'folded')}, {sql.extract('text', regex.to_jvm(r.pattern))}, NULL)")
          .alias(r.rule_id.replace("-", "_")) for r in rules],
    ).collect()
    for rule in rules:
        python = re.compile(rule.pattern, re.IGNORECASE)
        for row in got:
            want = python.search(texts[row.i])
            assert row[rule.rule_id.replace("-", "_")] == (want.group(0) if want else None), (rule.rule_id, texts[row.i])


def test_case_sensitive_patterns_match_like_python(spark):
    patterns = [fv.JS_EXEC_CALL, fv.JS_EVAL_CALL, fv.JS_IDENTIFIER_ARGUMENT, fv.JS_TEMPLATE_DYNAMIC, fv.JS_CONCAT,
                fv.JS_COMMENT_LINE, fv.NPM_X_SEGMENT, fv.DEPENDENCY_NAME, *[p for _, p in fv.PROVIDER_TOKENS]]
    texts = ["exec (a)", ".exec(a)", "éexec(a)", "$eval(x)", "new\u00a0Function(y)", "  ident.a$b ,", "é , x", "`a${", "'a' +",
             "\u3000// x", " * y", "1.x", "x.1", "axb", "a-b>=1", "[x]", "sk-ant-" + "a" * 20, "éAKIA" + "A" * 16, "évalué(x)"]
    got = rows(spark, texts).select(
        "i", *[F.regexp_extract("text", regex.to_jvm(p, ignore_case=False), 0).alias(f"p{n}") for n, p in enumerate(patterns)]
    ).collect()
    for n, pattern in enumerate(patterns):
        for row in got:
            want = re.search(pattern, texts[row.i])
            assert row[f"p{n}"] == (want.group(0) if want else ""), (pattern, texts[row.i])


def test_translation_of_shorthands():
    assert regex.to_jvm(r"\w[\s\d]", False) == f"[{regex.WORD}][{regex.SPACE}\\p{{Nd}}]"
    assert regex.to_jvm(r"[]a]", False) == r"[\]a]"
    assert regex.to_jvm(r"[a[b&&c]", False) == r"[a\[b\&\&c]"
    assert regex.to_jvm(r"(?P<n>x)\Z", False) == r"(?<n>x)\z"
    assert not regex.is_valid("(")


def test_literals_survive_the_sql_parser(spark):
    texts = ["it's", r"a\b", "${name}", "$ {x}", "line\nbreak", "100%_", 'say "hi"', r"\\", "\u200b"]
    row = spark.range(1).select(F.expr(sql.array(texts)).alias("a")).first()
    assert row.a == texts


def test_path_context_is_relative_and_segment_based(spark):
    paths = {
        "src/main.py": (False, False), "tests/a.py": (True, False), "a/My_Tests/b.py": (True, False), "latest/a.py": (False, False),
        "x/test-data/b.js": (True, False), "src/test_a.py": (True, False), "src/a_test.py": (True, False),
        "src/a.spec.ts": (True, False), "src/a.spec.tsx": (False, False), "Scripts/x.py": (False, True), "build": (False, False),
        ".github/x.js": (False, True), "docs/ci/a.py": (True, True), "tests.py": (False, False), "e2e-tests/a.js": (True, False),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", is_test_path(F.col("path")).alias("t"), is_build_path(F.col("path")).alias("b")).collect()
    assert {r.path: (r.t, r.b) for r in got} == paths
