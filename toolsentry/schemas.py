"""Table schemas shared by sources, operators and sinks.

``files.path`` is relative to the target and ``/``-separated; ``files.location`` is how the
file is printed in findings. ``tools.input_schema`` is kept as JSON text because the order
of its properties is part of the data model.
"""

from __future__ import annotations

FILES = (
    "target STRING, path STRING, name STRING, ext STRING, role STRING, location STRING, content STRING"
)
TOOLS = "target STRING, tool STRING, description STRING, input_schema STRING, captured_at TIMESTAMP"
TARGETS = "target STRING, kind STRING, error STRING"
ALLOWLIST = "target STRING, fingerprint STRING"
VERDICTS = "fingerprint STRING, note STRING"
BASELINES = "target STRING, tool STRING, def_hash STRING, captured_at TIMESTAMP"
CALL_SITES = (
    "target STRING, path STRING, location STRING, line_no INT, module STRING, func STRING, "
    "arg_shape STRING, shell_true BOOLEAN"
)

FINDING_COLUMNS = [
    "target", "detector", "rule_id", "title", "severity", "owasp_id", "confidence",
    "location", "evidence", "recommendation",
]
FINDINGS = (
    "target STRING, detector STRING, rule_id STRING, title STRING, severity TINYINT, "
    "owasp_id STRING, confidence STRING, location STRING, evidence STRING, "
    "recommendation STRING, fingerprint STRING, note STRING"
)
