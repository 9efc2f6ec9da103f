"""All scans of config files over one read of their contents.

Every scan of configs says what it finds in a file as an array of hits, so the arrays of one file are put together in its
row. Contents are searched for the patterns of these scans in Python; only those that match are looked at by their rules.
Python manifests alone are read a second time, since TOML needs Python.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions import sql
from toolsentry.functions.text import RARE_BREAKS, is_test_path, split_lines
from toolsentry.operators import manifest_scan
from toolsentry.operators.hits import placed
from toolsentry.operators.line_scan import config_line_hits
from toolsentry.operators.manifest_scan import D4, D5
from toolsentry.operators.rules import Rule
from toolsentry.operators.secrets import secret_pattern
from toolsentry.operators.text_scan import INJECTION, Sift, default_rules, injection_hits

#: The registered scans that share the pass.
TEXTS, LINES, MANIFESTS = "config_texts", "lines", "manifests"
_BREAKS = "breaks"


def config_pass(files: DataFrame, scans: Collection[str], rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """What the chosen scans find in config files, as each of them would find it alone."""
    named = {**default_rules(), **(rules or {})}
    configs = files.filter((F.col("role") == "config") & F.col("content").isNotNull())
    others = ((_BREAKS, f"[{''.join(RARE_BREAKS)}]"),) + (((LINES, secret_pattern()),) if LINES in scans else ())
    sift = Sift(tuple(named[INJECTION]) if TEXTS in scans else (), others)
    rare = F.expr(sift.of(_BREAKS))
    read = configs.select(
        "target", "path", "name", "location", "content", is_test_path(F.col("path")).alias("in_test"),
        sift.marks(F.col("content")), F.lit(None).cast("string").alias("folded"),
    )
    parts = []
    if TEXTS in scans:
        if not all(rule.anchors for rule in named[INJECTION]):
            read = read.withColumn("folded", F.expr(sql.folded("content")))
        parts.append(placed(injection_hits("content", "folded", named[INJECTION], sift), "location"))
    if LINES in scans:
        read = read.withColumn("lines", F.when(F.expr(sift.of(LINES)), split_lines(F.col("content"), rare)))
        parts.append(config_line_hits("lines"))
    both = (D4, D5)
    if MANIFESTS in scans:
        wanted = F.when(F.col("name") == "requirements.txt", F.col("content"))
        read = read.withColumn("kept", manifest_scan.requirements(wanted, sift=True)).withColumn(
            "document", manifest_scan.json_documents(["package.json", *fv.CLIENT_CONFIG_NAMES]))
        client = F.when(F.col("name").isin(fv.CLIENT_CONFIG_NAMES), F.col("document"))
        read = read.withColumn("declared", manifest_scan.servers(client))
        parts += [manifest_scan.requirement_hits("kept", both), manifest_scan.server_hits("declared")]
    found = F.expr(f"flatten(array_compact(array({', '.join(parts)})))")
    if MANIFESTS not in scans:
        return read.select("target", F.inline(found))
    package = F.when(F.col("name") == "package.json", F.col("document")).alias("document")
    documents = read.select("target", "path", "location", package, found.alias("other"))
    npm = manifest_scan.npm_rows(documents, both, "other")
    rows = npm.withColumn("hits", F.concat("hits", "other")).drop("other")
    judged = manifest_scan.with_lockfile_hits(rows.unionByName(manifest_scan.pyproject_rows(files, both)), files)
    return judged.select("target", F.inline("hits"))
