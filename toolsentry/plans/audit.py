"""The whole audit as one lazy plan: tables in, findings and grades out."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from toolsentry.operators import config_pass, line_scan, manifest_scan, python_scan, text_scan
from toolsentry.operators.findings import finalize, suppress, union_findings
from toolsentry.operators.rules import Rule
from toolsentry.operators.scoring import corpus_summary

Tables = dict[str, DataFrame]
Detector = Callable[[Tables, dict[str, list[Rule]] | None], DataFrame]


@dataclass(frozen=True)
class Scan:
    """A registered scan: the tables it needs, the categories it reports, and its function."""

    needs: str
    categories: tuple[str, ...]
    run: Detector


# Scans that share a pass over their table are registered together.
SCANS: dict[str, Scan] = {
    "tool_texts": Scan("tools", ("MCP03", "MCP01", "MCP06", "MCP10"), lambda t, r: text_scan.tool_findings(t["tools"], r, sift=True)),
    "config_texts": Scan("files", ("MCP06",), lambda t, r: text_scan.config_findings(t["files"], r)),
    "lines": Scan("files", ("MCP01", "MCP05"), lambda t, r: line_scan.line_findings(t["files"], sift=True)),
    "python_calls": Scan("files", ("MCP05",), lambda t, r: python_scan.python_sink_findings(t["files"])),
    "manifests": Scan("files", ("MCP04", "MCP09"), lambda t, r: manifest_scan.manifest_findings(t["files"])),
}


def detector_categories(spark: SparkSession) -> DataFrame:
    """``(scan, owasp_id)`` of all registered scans."""
    return spark.createDataFrame(
        [(name, category) for name, scan in SCANS.items() for category in scan.categories],
        "scan STRING, owasp_id STRING",
    )


@dataclass
class Audit:
    """Inputs and options of an audit. Any of the tables may be missing.

    ``tools`` and ``files`` follow ``toolsentry.schemas``; ``scans`` limits which registered
    scans run; ``rules`` overrides rule packs by name.
    """

    tools: DataFrame | None = None
    files: DataFrame | None = None
    allowlist: DataFrame | None = None
    rules: dict[str, list[Rule]] | None = None
    scans: Collection[str] = field(default_factory=lambda: list(SCANS))
    id_prefix: str = ""

    def all_findings(self) -> DataFrame:
        """Findings before suppression."""
        tables = {k: v for k, v in (("tools", self.tools), ("files", self.files)) if v is not None}
        parts, alone = [], [name for name in self.scans if SCANS[name].needs in tables]
        shared = [name for name in alone if name in (config_pass.TEXTS, config_pass.LINES, config_pass.MANIFESTS)]
        if len(shared) > 1:
            # contents of configs are read once for all scans that look at them; lines of sources stay a scan of their own
            parts.append(config_pass.config_pass(self.files, shared, self.rules))
            if config_pass.LINES in shared:
                parts.append(line_scan.line_findings(self.files.filter("role = 'source'"), sift=True))
            alone = [name for name in alone if name not in shared]
        parts += [SCANS[name].run(tables, self.rules) for name in alone]
        return finalize(union_findings(parts), self.id_prefix)

    def findings(self) -> DataFrame:
        found = self.all_findings()
        return found if self.allowlist is None else suppress(found, self.allowlist)

    def corpus(self, targets: DataFrame) -> DataFrame:
        return corpus_summary(self.findings(), targets)
