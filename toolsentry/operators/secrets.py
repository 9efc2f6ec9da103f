"""Credential scan (detector D2) over single texts or lines, as SQL expressions."""

from __future__ import annotations

from toolsentry import fixed_values as fv
from toolsentry.functions import regex, sql
from toolsentry.functions.words import loose
from toolsentry.operators.hits import hit

DETECTOR = "D2"
OWASP_ID = "MCP01"
RULE_ID = "D2-SECRET"
RECOMMENDATION = "Keep credentials in a secret store or the environment and rotate this one if it was ever real."

# Literal text every match of a provider format contains (case-sensitive).
_PROVIDER_ANCHORS = {
    "Anthropic key": ["sk-ant-"],
    "OpenAI project key": ["sk-proj-"],
    "AWS access key": ["AKIA", "ASIA"],
    "GitHub token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"],
    "GitLab token": ["glpat-"],
    "npm token": ["npm_"],
    "Hugging Face token": ["hf_"],
    "Slack webhook": ["hooks.slack.com"],
    "SendGrid key": ["SG."],
    "Twilio key SID": ["SK"],
    "Azure storage key": ["AccountKey="],
    "JSON web token": ["eyJ"],
}
_GENERIC_ANCHORS = ["api", "secret", "token", "passw"]


def secret_pattern() -> str:
    """Found in every text with a credential match, for ``marks``."""
    formats = [loose(pattern, ignore_case=False) for _, pattern in fv.PROVIDER_TOKENS]
    return "|".join([*formats, loose(fv.GENERIC_SECRET)])


def may_hold_secret(text: str, folded: str) -> str:
    """Cheap test that is true for every text with a credential match."""
    literals = [word for words in _PROVIDER_ANCHORS.values() for word in words]
    return f"({sql.contains_any(text, literals)} OR {sql.may_contain_any(folded, _GENERIC_ANCHORS)})"


def holds_secret(text: str, folded: str) -> str:
    """Whether a line of a text may have a credential match: every match in a line is one in the whole text.

    A regex runs only on texts with a literal of its format, so most texts are never split into lines.
    """
    tests = [f"({sql.contains_any(text, _PROVIDER_ANCHORS[label])} AND {sql.rlike(text, regex.to_jvm(pattern, ignore_case=False))})"
             for label, pattern in fv.PROVIDER_TOKENS]
    tests.append(f"({sql.may_contain_any(folded, _GENERIC_ANCHORS)} AND {sql.rlike(text, regex.to_jvm(fv.GENERIC_SECRET))})")
    return f"({' OR '.join(tests)})"


def secret_hits(text: str, folded: str, in_test: str = "false") -> str:
    """All credential hits of a text: every provider format, then quoted assignments.

    An assignment is reported besides the provider match it may contain. Documented
    placeholder values are no hits; matches in test code are demoted one step.
    """

    def matches(label: str, jvm_pattern: str, severity: int, confidence: str, guard: str) -> str:
        level = f"if({in_test}, {sql.demoted(str(severity))}, {severity})"
        title = sql.quoted(f"Credential in plain text ({label})")
        found = hit(DETECTOR, sql.quoted(RULE_ID), title, level, OWASP_ID, sql.quoted(confidence), "m", RECOMMENDATION)
        real = f"filter({sql.extract_all(text, jvm_pattern)}, m -> NOT {sql.rlike('m', regex.to_jvm(fv.PLACEHOLDER))})"
        return f"CASE WHEN {guard} THEN transform({real}, m -> {found}) END"

    parts = [
        matches(label, regex.to_jvm(pattern, ignore_case=False), fv.HIGH, "high",
                sql.contains_any(text, _PROVIDER_ANCHORS[label]))
        for label, pattern in fv.PROVIDER_TOKENS
    ]
    parts.append(
        matches(fv.GENERIC_SECRET_LABEL, regex.to_jvm(fv.GENERIC_SECRET), fv.MEDIUM, "medium",
                sql.may_contain_any(folded, _GENERIC_ANCHORS))
    )
    return f"flatten(array_compact(array({', '.join(parts)})))"
