"""Reading rule packs (YAML, or JSON where no YAML reader is installed)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import astuple
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.functions import regex
from toolsentry.operators.rules import BUILTIN, Rule, merge_rules
from toolsentry.operators.text_scan import TEXT_DETECTORS, default_rules, tool_findings

RULES_SCHEMA = (
    "pack STRING, rule_id STRING, severity TINYINT, owasp_id STRING, confidence STRING, "
    "pattern STRING, title STRING, recommendation STRING, ord INT"
)


def read_pack(path: str | os.PathLike[str]) -> list[dict[str, object]]:
    """Entries of one pack file; an unreadable pack counts as empty."""
    try:
        text = Path(path).read_text("utf-8", "ignore")
    except OSError:
        return []
    try:
        try:
            import yaml
        except ImportError:
            loaded = json.loads(text)
        else:
            loaded = yaml.safe_load(text)
    except Exception:  # a broken pack must not stop the audit
        return []
    entries = loaded.get("rules") if isinstance(loaded, dict) else None
    return entries if isinstance(entries, list) else []


def first_pack(candidates: Iterable[str | os.PathLike[str] | None]) -> str | None:
    """First candidate that is a file; packs replace each other, they do not add up."""
    for candidate in candidates:
        if candidate and Path(candidate).is_file():
            return str(candidate)
    return None


def default_candidates(pack: str, environment: Mapping[str, str], folder: str | os.PathLike[str], packaged: str | os.PathLike[str] | None = None) -> list[str]:
    """Where a pack is looked for, in this order: the file that the environment names (``AUDIT_RULES_POISONING``), ``rules/poisoning.yaml``
    below a folder, and a packaged file. What is not given is no candidate; the first that is a file counts."""
    named = environment.get(f"AUDIT_RULES_{pack.upper()}")
    found = [named, os.path.join(folder, "rules", f"{pack}.yaml"), os.fspath(packaged) if packaged else None]
    return [path for path in found if path]


def load_rules(pack: str, *candidates: str | os.PathLike[str] | None, spark: SparkSession | None = None) -> list[Rule]:
    """Built-in rules of ``pack`` overlaid with the first pack file found."""
    path = first_pack(candidates)
    return merge_rules(pack, read_pack(path) if path else (), accepts=acceptance(spark))


def acceptance(spark: SparkSession | None = None) -> Callable[[str], bool]:
    """Whether a pattern is one for Python and for Spark; without a session the active one decides, and without any Python alone."""
    session = spark or SparkSession.getActiveSession()

    @cache
    def accepted(pattern: str) -> bool:
        if not regex.is_valid(pattern):
            return False
        if session is None:
            return True
        try:
            # a constant: the optimizer evaluates it, no job runs
            session.range(1).select(F.rlike(F.lit("x"), F.lit(regex.to_jvm(pattern)))).collect()
        except Exception:
            return False
        return True

    return accepted


#: Packs of many targets as one relation; ``ord`` is an entry's place in its pack.
ENTRIES = (
    "target STRING, pack STRING, ord INT, id STRING, pattern STRING, severity STRING, confidence STRING, title STRING, "
    "recommendation STRING, owasp_id STRING"
)
_FIELDS = ["id", "pattern", "severity", "confidence", "title", "recommendation", "owasp_id"]


def distinct_packs(entries: DataFrame) -> tuple[DataFrame, dict[str, dict[str, list[dict[str, str]]]]]:
    """``(target, pack_key)`` of the targets with entries of their own, and what each key stands for.

    Targets whose packs say the same share a key, so what reaches the driver grows with the different packs people write, not with
    the targets that use them.
    """
    entry = F.struct("pack", "ord", *_FIELDS)
    own = entries.groupBy("target").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("said"))
    keyed = own.select("target", F.sha2("said", 256).alias("pack_key"), "said")
    packs: dict[str, dict[str, list[dict[str, str]]]] = {}
    for row in keyed.groupBy("pack_key").agg(F.first("said").alias("said")).collect():
        by_pack = packs.setdefault(row.pack_key, {})
        for one in json.loads(row.said):
            by_pack.setdefault(one["pack"], []).append({k: one[k] for k in _FIELDS if k in one})
    return keyed.drop("said"), packs


def findings_by_pack(tools: DataFrame, entries: DataFrame, detectors: Collection[str] = TEXT_DETECTORS) -> DataFrame:
    """Findings on tools, each target under the built-in rules overlaid by its own ``entries``.

    One scan for each distinct effective set of rules, over the targets that have it: rules stay literal expressions. Packs of
    different spelling that come to the same rules share a scan, and so do the targets whose packs change nothing.
    """
    keyed, packs = distinct_packs(entries)
    accepts = acceptance(tools.sparkSession)
    scans: dict[tuple, tuple[dict[str, list[Rule]], list[str]]] = {}
    for key, by_pack in packs.items():
        rules = {pack: merge_rules(pack, by_pack.get(pack, ()), accepts) for pack in BUILTIN}
        effective = tuple((pack, tuple(map(astuple, merged))) for pack, merged in rules.items())
        scans.setdefault(effective, (rules, []))[1].append(key)
    plain = default_rules()
    own = [(rules, keys) for rules, keys in scans.values() if rules != plain]
    found = []
    for rules, keys in own:
        theirs = keyed.filter(F.col("pack_key").isin(keys)).select("target")
        found.append(tool_findings(tools.join(theirs, "target", "left_semi"), rules, detectors))
    changed = keyed.filter(F.col("pack_key").isin([k for _, keys in own for k in keys])).select("target")
    rest = tools.join(changed, "target", "left_anti") if own else tools
    return reduce(DataFrame.unionByName, found, tool_findings(rest, None, detectors))


def rules_table(spark: SparkSession, pack: str, rules: list[Rule]) -> DataFrame:
    """The merged rules as a table, for reports and joins on ``rule_id``."""
    rows = [
        (pack, r.rule_id, r.severity, r.owasp_id, r.confidence, r.pattern, r.title, r.recommendation, i)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
