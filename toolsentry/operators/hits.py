"""Hits: what one text yields, as an array of structs ready to inline into findings.

Everything here is SQL text, see ``toolsentry.functions.sql``.
"""

from __future__ import annotations

from toolsentry.functions import regex, sql
from toolsentry.operators.rules import Rule

HIT_TYPE = (
    "array<struct<detector:string,rule_id:string,title:string,severity:tinyint,owasp_id:string,"
    "confidence:string,evidence:string,recommendation:string>>"
)
NO_HITS = f"cast(array() as {HIT_TYPE})"


def hit(
    detector: str,
    rule_id: str,
    title: str,
    severity: int | str,
    owasp_id: str,
    confidence: str,
    evidence: str,
    recommendation: str,
    location: str | None = None,
) -> str:
    """One hit. ``rule_id``, ``title`` and ``confidence`` are SQL expressions like the evidence;
    ``location`` is given only where the hits of a row have different places."""
    fields = {
        "detector": sql.quoted(detector),
        "rule_id": rule_id,
        "title": title,
        "severity": f"cast({severity} as tinyint)",
        "owasp_id": sql.quoted(owasp_id),
        "confidence": confidence,
        "evidence": sql.truncated(evidence),
        "recommendation": sql.quoted(recommendation),
    }
    return sql.struct(**fields, **({} if location is None else {"location": location}))


def rule_matches(rule: Rule, text: str, folded: str, marked: str | None = None) -> str:
    """Whether a rule matches; the regex runs only on texts that are marked for it or hold its anchor words."""
    tests = [marked] if marked else [sql.may_contain_any(folded, list(group)) for group in rule.anchors]
    return " AND ".join([*tests, sql.rlike(text, regex.to_jvm(rule.pattern))])


def rule_hit(
    detector: str, owasp_id: str, rule: Rule, text: str, folded: str, whole_text: bool, marked: str | None = None,
    start: str | None = None,
) -> str:
    """One rule's hit or NULL. Evidence is the whole text or the first match; ``start`` is a character no match begins before."""
    searched = f"substring({text}, {start})" if marked and start else text
    evidence = text if whole_text else sql.extract(searched, regex.to_jvm(rule.pattern))
    found = hit(detector, sql.quoted(rule.rule_id), sql.quoted(rule.title), rule.severity, owasp_id,
                sql.quoted(rule.confidence), evidence, rule.recommendation)
    return f"CASE WHEN {rule_matches(rule, searched, folded, marked)} THEN {found} END"


def collected(hits: list[str]) -> str:
    """The hits that are there, of expressions that are NULL otherwise."""
    return f"array_compact(array({', '.join(hits)}))" if hits else NO_HITS


def placed(hits: str, location: str) -> str:
    """Hits without a place as hits at ``location``."""
    names = [field.split(":")[0] for field in HIT_TYPE[len("array<struct<"):-2].split(",")]
    return f"transform({hits}, h -> {sql.struct(**{n: f'h.{n}' for n in names}, location=location)})"
