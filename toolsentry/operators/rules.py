"""Rule packs: built-in pattern rules and how a user's pack overlays them.

Rules are configuration (a handful of rows), so they live on the driver and enter the plan
as literal patterns; nothing is ever matched through a join of texts with rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from toolsentry import fixed_values as fv
from toolsentry.functions import regex

POISONING = "poisoning"
INJECTION = "injection"
OVERSHARING = "oversharing"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: int
    confidence: str
    title: str
    recommendation: str
    owasp_id: str = ""
    # Every match needs at least one word of each group (lower case). Lets a plan skip the
    # regex on most texts; empty for rules whose pattern came from a pack.
    anchors: tuple[tuple[str, ...], ...] = ()


BUILTIN: dict[str, list[Rule]] = {
    POISONING: [
        Rule("D1-EXFIL", fv.EXFIL, fv.CRITICAL, "high",
             "Tool text tells the agent to send data elsewhere",
             "Do not connect this server before its network behaviour has been reviewed.", "MCP03",
             (("http", "webhook", "endpoint", "server", "url", "address"),
              ("send", "post", "upload", "exfiltrat", "forward", "transmit", "leak", "report"))),
        Rule("D1-SENSITIVE-READ", fv.SENSITIVE_READ, fv.HIGH, "high",
             "Tool text names credential or key files",
             "Check why the tool would need these files and deny access to them.", "MCP03",
             ((".ssh", "id_rsa", "id_ed25519", ".env", ".aws/credentials", ".config/",
               "/etc/passwd", ".netrc", "secret"),)),
        Rule("D1-DIRECTIVE", fv.DIRECTIVE, fv.MEDIUM, "medium",
             "Tool text gives orders to the model",
             "Ask for a description that says what the tool does instead of steering the model.", "MCP03",
             (("previous", "disregard ", "do not ", "don't ", "before ", "you must", "always ", "without "),)),
    ],
    INJECTION: [
        Rule("INJ-SYSTEM-OVERRIDE", fv.SYSTEM_OVERRIDE, fv.HIGH, "medium",
             "Text asks the model to drop its instructions",
             "Remove the text; a tool surface has no business changing governing instructions.", "MCP06",
             (("system ", "instructions", "guidelines", "safety rules", "restrictions"),
              ("ignore", "disregard", "forget", "override", "bypass"))),
        Rule("INJ-ROLE-HIJACK", fv.ROLE_HIJACK, fv.HIGH, "medium",
             "Text pushes the model into an unrestricted persona",
             "Regard the server as hostile until its owner explains the text.", "MCP06",
             (("you are", "act as", "enable"),
              ("dan", "developer mode", "jailbroken", "unrestricted", "no restrictions", "no rules",
               "no guidelines", "without "))),
        Rule("INJ-PROMPT-LEAK", fv.PROMPT_LEAK, fv.MEDIUM, "medium",
             "Text asks for the hidden prompt",
             "Remove the text; a tool never needs the hidden prompt.", "MCP06",
             (("prompt", "instructions", "everything above"),
              ("reveal", "repeat", "print", "show", "output", "disclose", "tell me"))),
        Rule("INJ-DELIMITER", fv.DELIMITER, fv.MEDIUM, "medium",
             "Text contains chat-role or prompt delimiters",
             "Strip the markers, they can forge a turn of the conversation.", "MCP06",
             (("<", "inst]", "###"), ("system", "assistant", "user", "instruction", "inst]", "im_start", "im_end"))),
        Rule("INJ-NEW-INSTRUCTIONS", fv.NEW_INSTRUCTIONS, fv.MEDIUM, "medium",
             "Text announces replacement instructions",
             "Find out who wrote the text and what it is meant to achieve.", "MCP06",
             (("instruction", "from now on"),)),
    ],
    OVERSHARING: [
        Rule("D7-BULK-SECRETS", fv.BULK_SECRETS, fv.HIGH, "medium",
             "Tool seems to hand out secrets or environment in bulk",
             "Return only the one value a task needs.", "MCP10",
             (("secret", "credential", "env", "api key", "token", "password"),
              ("all", "every", "each", "the"))),
        Rule("D7-BROAD-READ", fv.BROAD_READ, fv.MEDIUM, "medium",
             "Tool reads a whole collection",
             "Offer filters or paging so a call returns what was asked for.", "MCP10",
             (("all", "every", "entire", "whole", "any"),
              ("read", "return", "fetch", "retrieve", "dump", "export", "list", "send", "expose", "collect"),
              ("file", "record", "row", "field", "column", "document", "message", "email", "user",
               "conversation", "chat history"))),
        Rule("D7-UNBOUNDED-SCOPE", fv.UNBOUNDED_SCOPE, fv.LOW, "medium",
             "Tool declares an unlimited or recursive scope",
             "Bound the path, the depth and the size of the result.", "MCP10",
             (("limit", "unbounded", "recursively", "entire ", "arbitrary ", "any "),)),
        Rule("D7-SELECT-STAR", fv.SELECT_STAR, fv.LOW, "low",
             "Tool returns every column",
             "Name the columns the tool needs.", "MCP10",
             (("*",), ("select",))),
    ],
}

_NEW_RULE = {
    POISONING: Rule("", "", fv.MEDIUM, "medium", "Suspicious tool text",
                    "Compare the text with what the server claims to do.", "MCP03"),
    INJECTION: Rule("", "", fv.MEDIUM, "medium", "Prompt-injection signature",
                    "Check the text for attempts to steer the model.", "MCP06"),
}


def merge_rules(pack: str, entries: Iterable[Mapping[str, object]] = (), accepts=regex.is_valid) -> list[Rule]:
    """Built-in rules of a pack overlaid, field by field and by id, with user entries.

    An entry without id, with a pattern ``accepts`` refuses, or without any pattern to fall
    back on is dropped; unknown severities and confidences fall back like missing ones.
    """
    merged = {rule.rule_id: rule for rule in BUILTIN[pack]}
    for entry in entries:
        if not isinstance(entry, Mapping) or "id" not in entry:
            continue
        rule_id = str(entry["id"])
        known = merged.get(rule_id)
        fallback = known or replace(_NEW_RULE[pack], rule_id=rule_id)
        if not entry.get("pattern") and known is None:
            continue
        changes: dict[str, object] = {}
        if entry.get("pattern"):
            pattern = entry["pattern"]
            if not isinstance(pattern, str) or not accepts(pattern):
                continue
            changes["pattern"] = pattern
            if pattern != fallback.pattern:
                changes["anchors"] = ()
        severity = str(entry.get("severity", "")).upper()
        if severity in fv.SEVERITY_NAMES:
            changes["severity"] = fv.SEVERITY_NAMES.index(severity)
        confidence = str(entry.get("confidence", "")).lower()
        if confidence in fv.CONFIDENCE_NAMES:
            changes["confidence"] = confidence
        if "owasp_id" in entry:
            changes["owasp_id"] = str(entry["owasp_id"])
        described = entry.get("description") if known is None and pack == POISONING else None
        for field in ("title", "recommendation"):
            text = entry.get(field) or described
            if text:
                changes[field] = str(text)
        merged[rule_id] = replace(fallback, **changes)
    return list(merged.values())
