"""Pattern scans over tool texts: poisoning (D1), credentials (D2), injection (D6) and
over-sharing (D7), evaluated together in one pass over each tool row.

The rows never shuffle: a tool's texts are entries of an array in its own row, every rule is
a literal expression, and only rows with hits leave the final generator.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import regex, sql
from toolsentry.functions.words import first_marks, loose, marked, only_where
from toolsentry.operators import secrets
from toolsentry.operators.hits import NO_HITS, collected, hit, rule_hit
from toolsentry.operators.rules import BUILTIN, INJECTION, OVERSHARING, POISONING, Rule
from toolsentry.operators.tool_text import tool_entries

D1, D2, D6, D7 = "D1", "D2", "D6", "D7"
TEXT_DETECTORS = (D1, D2, D6, D7)
_PACKS = {D1: POISONING, D6: INJECTION, D7: OVERSHARING}
_OWASP = {D1: "MCP03", D2: "MCP01", D6: "MCP06", D7: "MCP10"}


def default_rules() -> dict[str, list[Rule]]:
    return dict(BUILTIN)


@dataclass(frozen=True)
class Sift:
    """What one search of a text looks for: patterns of rules by id, and others by a name. Rules of packs that bring their own
    pattern have no anchors and are not looked for; they run on every text."""

    rules: tuple[Rule, ...] = ()
    others: tuple[tuple[str, str], ...] = ()
    column: str = "marks"

    def patterns(self) -> dict[str, str]:
        return {rule.rule_id: loose(rule.pattern) for rule in self.rules if rule.anchors} | dict(self.others)

    def of(self, name: str) -> str | None:
        names = list(self.patterns())
        return marked(names.index(name), f"{self.column}.found") if name in names else None

    @property
    def start(self) -> str:
        return f"{self.column}.start"

    def marks(self, text: Column) -> Column:
        patterns = list(self.patterns().values())
        return first_marks(text, patterns, len(patterns) - len(self.others)).alias(self.column)


NO_SIFT = Sift()


#: What else poisoning rules look for in a text, by the name of its mark.
HIDDEN, COMMENT = "hidden", "comment"
_POISONING_SIGNS = ((HIDDEN, "[" + "".join(fv.HIDDEN_CHARACTERS) + "]"), (COMMENT, "<!--"))


def hidden_unicode_hit(text: str, marked: str | None = None) -> str:
    """The first invisible character of a text, named."""
    named = ", ".join(
        f"{sql.quoted(ch)}, {sql.quoted(f'U+{ord(ch):04X} ({name})')}" for ch, name in fv.HIDDEN_CHARACTERS.items()
    )
    first = sql.extract(text, "[" + "".join(fv.HIDDEN_CHARACTERS) + "]")
    found = hit(
        D1, "'D1-HIDDEN-UNICODE'", "'Invisible characters in tool text'", fv.HIGH, _OWASP[D1], "'high'",
        f"element_at(map({named}), {first})",
        "Look at the raw bytes and reject the tool unless there is a reason for them.",
    )
    return f"CASE WHEN {marked or sql.contains_any(text, list(fv.HIDDEN_CHARACTERS))} THEN {found} END"


def comment_smuggle_hits(text: str, rules: list[Rule], marked: str | None = None) -> str:
    """Every markup comment that itself matches the directive or sensitive-file rule."""
    judges = [r for r in rules if r.rule_id in ("D1-DIRECTIVE", "D1-SENSITIVE-READ")]
    telling = " OR ".join(sql.rlike("c", regex.to_jvm(judge.pattern)) for judge in judges) or "false"
    comments = sql.extract_all(text, regex.to_jvm(fv.HTML_COMMENT, ignore_case=False, dot_all=True))
    found = hit(D1, "'D1-COMMENT-SMUGGLE'", "'Orders hidden in a markup comment'", fv.HIGH, _OWASP[D1], "'high'", "c",
                "Reject the tool: its comment addresses the model, not the reader.")
    return (
        f"CASE WHEN {marked or f"contains({text}, '<!--')"} AND contains({text}, '-->') "
        f"THEN transform(filter({comments}, c -> {telling}), c -> {found}) ELSE {NO_HITS} END"
    )


def poisoning_hits(text: str, folded: str, rules: list[Rule], sift: Sift = NO_SIFT) -> str:
    single = collected(
        [hidden_unicode_hit(text, sift.of(HIDDEN))]
        + [rule_hit(D1, _OWASP[D1], r, text, folded, True, sift.of(r.rule_id), sift.start) for r in rules]
    )
    return sql.concat(single, comment_smuggle_hits(text, rules, sift.of(COMMENT)))


def injection_hits(text: str, folded: str, rules: list[Rule], sift: Sift = NO_SIFT) -> str:
    return collected([rule_hit(D6, _OWASP[D6], r, text, folded, False, sift.of(r.rule_id), sift.start) for r in rules])


def oversharing_hits(text: str, folded: str, rules: list[Rule], sift: Sift = NO_SIFT) -> str:
    return collected([rule_hit(D7, _OWASP[D7], r, text, folded, False, sift.of(r.rule_id), sift.start) for r in rules])


def tool_findings(
    tools: DataFrame,
    rules: dict[str, list[Rule]] | None = None,
    detectors: Collection[str] = TEXT_DETECTORS,
    sift: bool = False,
) -> DataFrame:
    """Findings of the chosen detectors on declared tools. Also runs on a stream of tools.

    With ``sift`` texts are searched for all patterns in Python before any rule looks at them.
    """
    rules = {**default_rules(), **(rules or {})}
    per_entry = [d for d in (D1, D2, D6) if d in detectors]
    entry_type = "array<struct<where:string,text:string>>"
    passages = F.col("entries") if per_entry else F.array().cast(entry_type)
    if D7 in detectors:
        blob = F.struct(F.lit(None).cast("string").alias("where"), F.col("blob").alias("text"))
        passages = F.concat(passages, F.array(blob))
    texts = (
        tool_entries(tools)
        .select("target", "tool", F.inline(passages))
    )
    sieve, shared, folded = NO_SIFT, NO_SIFT, sql.folded("text")
    if sift:
        # entries and blobs are looked at by different rules, so each is searched for its own alone
        used = [rule for d in (D1, D6) if d in detectors for rule in rules[_PACKS[d]]]
        others = (_POISONING_SIGNS if D1 in detectors else ()) + (((D2, secrets.secret_pattern()),) if D2 in detectors else ())
        folded = "cast(NULL as string)"
        if per_entry:
            sieve = Sift(tuple(used), others)
            texts = texts.withColumn("marks", sieve.marks(F.when(F.col("where").isNotNull(), F.col("text"))))
            # rules whose regex is looked for need no folded text
            folded = only_where(sieve.of(D2), sql.folded("text")) if D2 in detectors else folded
        if D7 in detectors:
            shared = Sift(tuple(rules[OVERSHARING]), column="blob_marks")
            texts = texts.withColumn("blob_marks", shared.marks(F.when(F.col("where").isNull(), F.col("text"))))
    texts = texts.withColumn("folded", F.expr(folded))
    hits = [NO_HITS]
    if D1 in detectors:
        hits.append(poisoning_hits("text", "folded", rules[POISONING], sieve))
    if D2 in detectors:
        found = secrets.secret_hits("text", "folded")
        hits.append(f"coalesce({only_where(sieve.of(D2), found)}, {NO_HITS})" if sift else found)
    if D6 in detectors:
        hits.append(injection_hits("text", "folded", rules[INJECTION], sieve))
    found = sql.concat(*hits)
    if D7 in detectors:
        found = f"CASE WHEN `where` IS NULL THEN {oversharing_hits('text', 'folded', rules[OVERSHARING], shared)} ELSE {found} END"
    place = F.concat(F.col("target"), F.lit(" :: tool '"), F.col("tool"), F.lit("'"))
    location = F.when(F.col("where").isNull(), place).otherwise(
        F.concat(place, F.lit(" ("), F.col("where"), F.lit(")"))
    )
    return texts.select("target", location.alias("location"), F.inline(F.expr(found)))


def passage_findings(
    passages: DataFrame, text: Column, location: Column, rules: dict[str, list[Rule]] | None = None
) -> DataFrame:
    """Injection findings on free text (config files, chat turns), one location per row."""
    rules = {**default_rules(), **(rules or {})}
    return (
        passages.select("target", location.alias("location"), text.alias("text"))
        .withColumn("folded", F.expr(sql.folded("text")))
        .select("target", "location", F.inline(F.expr(injection_hits("text", "folded", rules[INJECTION]))))
    )


def config_findings(files: DataFrame, rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Injection findings over the whole text of each config file."""
    configs = files.filter(F.col("role") == "config")
    return passage_findings(configs, F.col("content"), F.col("location"), rules)

