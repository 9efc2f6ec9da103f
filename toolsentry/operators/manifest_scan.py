"""Manifest scans: dependency hygiene (D4) and declared-server inventory (D5).

Every manifest is parsed once into arrays inside its own row; the only join is the lockfile
coverage of package.json and pyproject.toml, which shuffles keys and small arrays, no text.
"""

from __future__ import annotations

import tomllib
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from toolsentry import fixed_values as fv
from toolsentry.functions import regex, sql
from toolsentry.functions.text import RARE_BREAKS, base_name, dependency_name, split_lines, strip
from toolsentry.functions.words import lines_with
from toolsentry.operators.hits import HIT_TYPE, collected, hit
from toolsentry.operators.tool_text import as_text, present

D4, D5 = "D4", "D5"
HYGIENE_OWASP_ID = "MCP04"
INVENTORY_OWASP_ID = "MCP09"
VARIANT_MAP = "map<string,variant>"
_NO_HITS = f"cast(array() as {HIT_TYPE[:-2]},location:string>>)"
_NO_NAMES = "cast(array() as array<struct<name:string,evidence:string>>)"


def _member(document: Column, key: str) -> Column:
    return F.try_variant_get(document, f"$.{key}", "variant")


def _as_map(value: Column) -> Column:
    return value.try_cast(VARIANT_MAP)


def _entries(members: Column) -> Column:
    return F.coalesce(F.map_entries(members), F.array().cast("array<struct<key:string,value:variant>>"))


def _json_manifests(files: DataFrame, names: list[str]) -> DataFrame:
    """Parsed JSON files; ``document`` is NULL unless the file holds an object."""
    return files.filter(F.col("name").isin(names) & (F.col("role") == "config")).select(
        "target", "path", "location", json_documents(names).alias("document")
    )


def json_documents(names: list[str]) -> Column:
    """The parsed content of files of these names; NULL for all others and unless the file holds an object."""
    is_object = F.rlike("content", F.lit(f"^[{regex.SPACE}]*\\{{")) & F.expr(
        "(endswith(content, '}') OR endswith(trim(TRAILING ' \\t\\n\\r' FROM content), '}'))"
    )
    return F.when(F.col("name").isin(names) & is_object, F.try_parse_json("content"))


def _package_manifests(documents: DataFrame, *more: str) -> DataFrame:
    """Parsed package.json files (and the columns ``more``) with each section as a map.

    ``bad_<section>`` tells that a section is there but no object; a file with one yields
    nothing to the checks that read the section.
    """
    sections = ["scripts", *fv.NPM_SECTIONS]
    members = documents.select(
        "target", "path", "location", *more, F.col("document").isNotNull().alias("parsed"),
        *[_member(F.col("document"), s).alias(s) for s in sections],
    )
    return members.select(
        "target", "path", "location", *more, "parsed",
        *[_as_map(F.col(s)).alias(s) for s in sections],
        *[(_as_map(F.col(s)).isNull() & present(F.col(s))).alias(f"bad_{s}") for s in sections],
    )


def _sound(sections: Collection[str]) -> Column:
    verdict = F.col("parsed")
    for section in sections:
        verdict = verdict & ~F.col(f"bad_{section}")
    return verdict


# -- dependencies ---------------------------------------------------------------------------


def _npm_dependencies(sections: list[str]) -> Column:
    """``array<struct<section, dep, spec>>``; the last section naming a dependency wins."""

    def of_section(section: str, later: list[str]) -> Column:
        def own(entry: Column) -> Column:
            keep = F.lit(True)
            for other in later:
                keep = keep & ~F.coalesce(F.map_contains_key(other, entry["key"]), F.lit(False))
            return keep

        return F.transform(
            F.filter(_entries(F.col(section)), own),
            lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("dep"), e["value"].alias("spec")),
        )

    return F.concat(*[of_section(s, sections[i + 1:]) for i, s in enumerate(sections)])


def npm_deps(files: DataFrame, sections: list[str] = fv.NPM_SECTIONS) -> DataFrame:
    """``(target, path, section, dep, spec, spec_is_string)`` of every package.json."""
    return (
        _package_manifests(_json_manifests(files, ["package.json"]))
        .filter(_sound(sections))
        .select("target", "path", F.inline(_npm_dependencies(sections)))
        .select(
            "target", "path", "section", "dep",
            F.try_variant_get("spec", "$", "string").alias("spec"),
            (F.schema_of_variant("spec") == "STRING").alias("spec_is_string"),
        )
    )


@F.pandas_udf(ArrayType(StringType()))
def _project_dependencies(contents: pd.Series) -> pd.Series:
    def read(content: str | None) -> list[str] | None:
        try:
            project = tomllib.loads(content).get("project") or {}
            return [str(d) for d in project.get("dependencies") or []]
        except (ValueError, TypeError, AttributeError, RecursionError):
            return None

    return contents.map(read)


# not deterministic in name only: keeps filters on the result from calling it a second time
_project_dependencies = _project_dependencies.asNondeterministic()


def _pyprojects(files: DataFrame) -> DataFrame:
    return files.filter((F.col("name") == "pyproject.toml") & (F.col("role") == "config")).select(
        "target", "path", "location", _project_dependencies("content").alias("requirements")
    )


def pyproject_deps(files: DataFrame) -> DataFrame:
    """``(target, path, requirement, dep)`` of ``[project].dependencies``."""
    return (
        _pyprojects(files)
        .select("target", "path", F.explode("requirements").alias("requirement"))
        .withColumn("dep", dependency_name(F.col("requirement")))
        .filter(F.col("dep") != "")
    )


#: Lines of a requirements.txt file that may be kept begin with something else than a comment or an option.
_NAMING = rf"^[{regex.SPACES}]*[^{regex.SPACES}#-]"


def requirements(content: Column, sift: bool = False) -> Column:
    """``array<struct<line_no, requirement, dep>>`` of the kept lines of a requirements.txt file.

    With ``sift`` they are looked for in Python; a file that is NULL then has none.
    """
    if sift:
        numbered = F.transform(lines_with(content, _NAMING, RARE_BREAKS), lambda r: F.struct((r["at"] + 1).alias("line_no"), r["line"].alias("line")))
    else:
        numbered = F.transform(split_lines(content), lambda line, at: F.struct((at + 1).alias("line_no"), line.alias("line")))
    first = lambda r: F.substring(F.ltrim(r["line"], F.lit(regex.SPACES)), 1, 1)
    kept = F.filter(numbered, lambda r: ~first(r).isin("", "#", "-"))
    stripped = F.transform(kept, lambda r: F.struct(r["line_no"].alias("line_no"), strip(r["line"]).alias("requirement")))
    return F.transform(stripped, lambda r: F.struct(r["line_no"].alias("line_no"), r["requirement"].alias("requirement"), dependency_name(r["requirement"]).alias("dep")))


def _requirement_files(files: DataFrame) -> DataFrame:
    return files.filter((F.col("name") == "requirements.txt") & (F.col("role") == "config"))


def requirements_deps(files: DataFrame) -> DataFrame:
    """``(target, path, line_no, requirement, dep)`` of every kept requirements.txt line."""
    lines = _requirement_files(files).select("target", "path", F.inline(requirements(F.col("content"))))
    return lines.filter(F.col("dep") != "")


def manifest_deps(files: DataFrame) -> DataFrame:
    """All declared dependencies in one table."""
    npm = npm_deps(files).select(
        "target", "path", F.lit("npm").alias("ecosystem"), "section", "dep", "spec", "spec_is_string",
        F.lit(None).cast("int").alias("line_no"),
    )
    pyproject = pyproject_deps(files).select(
        "target", "path", F.lit("python").alias("ecosystem"), F.lit("project").alias("section"), "dep",
        F.col("requirement").alias("spec"), F.lit(True).alias("spec_is_string"),
        F.lit(None).cast("int").alias("line_no"),
    )
    lines = requirements_deps(files).select(
        "target", "path", F.lit("python").alias("ecosystem"), F.lit("requirements").alias("section"), "dep",
        F.col("requirement").alias("spec"), F.lit(True).alias("spec_is_string"), "line_no",
    )
    return npm.unionByName(pyproject).unionByName(lines)


def manifest_errors(files: DataFrame) -> DataFrame:
    """Manifests that yield nothing because they are malformed: ``(target, path)``."""
    files = files.filter(F.col("content").isNotNull())
    npm = _package_manifests(_json_manifests(files, ["package.json"])).filter(~_sound(["scripts", *fv.NPM_SECTIONS]))
    clients = _json_manifests(files, fv.CLIENT_CONFIG_NAMES).filter(F.col("document").isNull())
    projects = _pyprojects(files).filter(F.col("requirements").isNull())
    return npm.select("target", "path").unionByName(clients.select("target", "path")).unionByName(
        projects.select("target", "path")
    )


# -- predicates, as SQL expressions ---------------------------------------------------------------


def npm_loose(spec: str) -> str:
    """Whether an npm spec can resolve to an unpredictable version."""
    plain = f"lower({sql.strip(spec)})"
    return (
        f"({plain} IN ({', '.join(sql.quoted(w) for w in fv.NPM_LOOSE_WORDS)}) OR contains({plain}, '://') "
        f"OR exists({sql.array(fv.NPM_LOOSE_PREFIXES)}, prefix -> startswith({plain}, prefix)) "
        f"OR {sql.rlike(plain, regex.to_jvm(fv.NPM_X_SEGMENT, ignore_case=False))}) "
        f"AND NOT exists({sql.array(fv.NPM_EXEMPT_PREFIXES)}, prefix -> startswith({spec}, prefix))"
    )


def python_loose(requirement: str, name: str) -> str:
    """Whether a Python requirement has no version bound at all, or a wildcard."""
    bound = sql.strip(f"substring({requirement}, length({name}) + 1)")
    return f"({bound} = '' OR contains({bound}, '*'))"


def lookalike(name: str) -> str:
    """The alphabetically first popular package at edit distance one, or NULL."""
    near = f"abs(length(popular) - length({name})) <= 1 AND levenshtein({name}, popular, 1) = 1"
    return f"array_min(filter({sql.array(fv.POPULAR_PACKAGES)}, popular -> {near}))"


# -- lockfile coverage ----------------------------------------------------------------------------


def _ecosystem(names: dict[str, list[str]]) -> Column:
    name = F.col("name")
    return F.when(name.isin(names["npm"]), F.lit("npm")).when(name.isin(names["python"]), F.lit("python"))


def ancestor_directories(path: Column) -> Column:
    """The directories a lockfile may lie in: beside the file and upwards to the target root."""
    segments = F.split(path, "/")
    deepest = F.size(segments) - 1
    levels = F.sequence(deepest, F.greatest(F.lit(0), deepest - (fv.LOCKFILE_MAX_LEVELS - 1)))
    return F.transform(levels, lambda depth: F.array_join(F.slice(segments, 1, depth), "/"))


def lock_cover(files: DataFrame) -> DataFrame:
    """``(target, path)`` of manifests with a lockfile of their ecosystem beside or above.

    Reads names only, and only of configs and lockfiles: a files table is partitioned by role. A large target has
    many manifests under one root directory; the optimizer splits such a key where it is found to be hot.
    """
    manifests = (
        files.filter((F.col("role") == "config") & F.col("name").isin("package.json", "pyproject.toml"))
        .withColumn("ecosystem", _ecosystem({"npm": ["package.json"], "python": ["pyproject.toml"]}))
        .select("target", "path", "ecosystem", F.explode(ancestor_directories(F.col("path"))).alias("directory"))
    )
    locks = (
        files.filter(F.col("role") == "lock")
        .withColumn("ecosystem", _ecosystem({"npm": fv.NPM_LOCKFILES, "python": fv.PYTHON_LOCKFILES}))
        .filter(F.col("ecosystem").isNotNull())
        .select(
            "target", "ecosystem",
            F.substring(
                F.col("path"), F.lit(1), F.greatest(F.lit(0), F.length("path") - F.length(base_name(F.col("path"))) - 1)
            ).alias("directory"),
        )
        .distinct()
    )
    covered = manifests.join(locks, ["target", "ecosystem", "directory"], "left_semi")
    return covered.select("target", "path").distinct()


# -- findings -----------------------------------------------------------------------------------------


def _under(part: str) -> str:
    return f"concat(location, ' :: ', {part})"


def _inventory_hit(title: str, evidence: str, advice: str) -> str:
    return hit(D5, "'D5-SHADOW'", title, fv.INFO, INVENTORY_OWASP_ID, "'high'", evidence, advice, "location")


def _sdk_hit(name: str) -> str:
    return _inventory_hit(
        f"concat('Depends on a tool-server SDK (', {name}, ')')", name,
        "The package probably defines a server; enter it in the inventory of known servers.",
    )


def _unpinned_hit(name: str, evidence: str, severity: str, place: str) -> str:
    return hit(D4, "'D4-UNPINNED'", f"concat('Dependency without a usable version bound: ', {name})", severity,
               HYGIENE_OWASP_ID, "'medium'", evidence, "Bound or pin the version and commit a lockfile.", place)


def _lookalike_hits(named: str) -> str:
    """Hits of an ``array<struct<name, popular, …>>``."""
    found = hit(
        D4, "'D4-TYPOSQUAT'", "concat('Dependency ', d.name, ' is one edit from ', d.popular)", fv.MEDIUM,
        HYGIENE_OWASP_ID, "'low'", "concat(d.name, ' vs ', d.popular)", "Make sure the intended package is meant.",
        _under("d.name"),
    )
    return f"transform(filter({named}, d -> d.popular IS NOT NULL), d -> {found})"


def _hook_hits() -> str:
    """Hits of ``hooks``, an ``array<struct<hook, body>>`` with NULL bodies for absent hooks."""
    fetches = sql.rlike("h.body", regex.to_jvm(fv.FETCH_EXEC))
    found = hit(
        D4,
        f"if({fetches}, 'D4-INSTALL-FETCH-EXEC', 'D4-INSTALL-SCRIPT')",
        f"concat('npm ', h.hook, if({fetches}, ' hook fetches or pipes into an interpreter', ' hook runs on installation'))",
        f"if({fetches}, {fv.HIGH}, {fv.MEDIUM})",
        HYGIENE_OWASP_ID,
        f"if({fetches}, 'high', 'medium')",
        "h.body",
        "Read the hook before installing; it runs without anyone asking for it.",
        _under("concat('scripts.', h.hook)"),
    )
    return f"transform(filter(hooks, h -> h.body IS NOT NULL), h -> {found})"


def _hooks() -> Column:
    bodies = []
    for hook in fv.INSTALL_HOOKS:
        body = F.col("scripts")[hook]
        bodies.append(F.struct(F.lit(hook).alias("hook"), F.when(present(body), as_text(body)).alias("body")))
    return F.array(*bodies)


def npm_rows(documents: DataFrame, detectors: Collection[str], *more: str) -> DataFrame:
    """Per package.json: hits that need no lockfile, the loose dependencies, and the columns ``more``.

    Files that are no object stay in as rows without hits; filtering on the parsed document
    would parse it twice.
    """
    hits, loose = [_NO_HITS], _NO_NAMES
    judged = _package_manifests(documents, *more)
    sound = _sound(["scripts", *fv.NPM_SECTIONS])
    if D4 in detectors:
        spelled = "if(schema_of_variant(d.spec) = 'STRING', try_variant_get(d.spec, '$', 'string'), NULL)"
        facts = f"transform(deps, d -> {sql.struct(name='d.dep', popular=lookalike('d.dep'), spec=spelled)})"
        judged = judged.withColumn("deps", F.when(sound, _npm_dependencies(fv.NPM_SECTIONS))).select(
            "*", F.expr(facts).alias("facts"), F.when(sound, _hooks()).alias("hooks")
        )
        hits += [f"coalesce({_hook_hits()}, {_NO_HITS})", f"coalesce({_lookalike_hits('facts')}, {_NO_HITS})"]
        evidence = "concat(d.name, ': ', d.spec)"
        loose = (
            f"coalesce(transform(filter(facts, d -> coalesce({npm_loose('d.spec')}, false)), "
            f"d -> {sql.struct(name='d.name', evidence=evidence)}), {_NO_NAMES})"
        )
    if D5 in detectors:
        declared = ["dependencies", "devDependencies"]
        names = F.array_union(*[F.transform(_entries(F.col(s)), lambda e: e["key"]) for s in declared])
        judged = judged.withColumn("names", F.when(_sound(declared), names))
        own = f"array_contains({sql.array(fv.SDK_PACKAGES)}, n) OR startswith(n, {sql.quoted(fv.SDK_NPM_SCOPE)})"
        hits.append(f"coalesce(transform(filter(names, n -> {own}), n -> {_sdk_hit('n')}), {_NO_HITS})")
    return judged.select(
        "target", "path", "location", *more, F.lit("npm").alias("ecosystem"), sound.alias("sound"),
        F.expr(sql.concat(*hits)).alias("hits"), F.expr(loose).alias("loose"),
    )


def pyproject_rows(files: DataFrame, detectors: Collection[str]) -> DataFrame:
    requirements = F.transform(
        F.col("requirements"), lambda r: F.struct(dependency_name(r).alias("name"), r.alias("evidence"))
    )
    hits, loose = [_NO_HITS], _NO_NAMES
    if D4 in detectors:
        near = sql.struct(name="lower(d.name)", popular=lookalike("lower(d.name)"))
        hits.append(_lookalike_hits(f"transform(named, d -> {near})"))
        loose = f"filter(named, d -> {python_loose('d.evidence', 'd.name')})"
    if D5 in detectors:
        own = f"array_contains({sql.array(fv.SDK_PACKAGES)}, lower(d.name))"
        hits.append(f"transform(filter(named, d -> {own}), d -> {_sdk_hit('lower(d.name)')})")
    return (
        _pyprojects(files)
        .filter(F.col("requirements").isNotNull())
        .withColumn("named", F.filter(requirements, lambda d: d["name"] != ""))
        .select(
            "target", "path", "location", F.lit("python").alias("ecosystem"), F.lit(True).alias("sound"),
            F.expr(sql.concat(*hits)).alias("hits"), F.expr(loose).alias("loose"),
        )
    )


def with_lockfile_hits(rows: DataFrame, files: DataFrame) -> DataFrame:
    covered = lock_cover(files).withColumn("locked", F.lit(True))
    npm = "ecosystem = 'npm'"
    severity = f"if({npm} AND locked, {fv.INFO}, {fv.LOW})"
    unpinned = f"transform(loose, d -> {_unpinned_hit('d.name', 'd.evidence', severity, _under('d.name'))})"
    missing = hit(
        D4, "'D4-NO-LOCKFILE'", f"if({npm}, 'npm manifest without lockfile', 'Python manifest without lockfile')",
        fv.LOW, HYGIENE_OWASP_ID, f"if({npm}, 'medium', 'low')",
        f"if({npm}, {sql.quoted(fv.EV_NO_NPM_LOCK)}, {sql.quoted(fv.EV_NO_PYTHON_LOCK)})",
        "Commit a lockfile so that installs are repeatable.", "location",
    )
    return (
        rows.join(covered, ["target", "path"], "left")
        .withColumn("locked", F.coalesce("locked", F.lit(False)))
        .withColumn("hits", F.expr(sql.concat("hits", unpinned, collected([f"CASE WHEN sound AND NOT locked THEN {missing} END"]))))
    )


def requirement_hits(kept: str, detectors: Collection[str]) -> str:
    """Hits of an ``array<struct<line_no, requirement, dep>>`` in a row with a ``location``."""
    hits = []
    if D4 in detectors:
        found = _unpinned_hit("r.dep", "r.requirement", str(fv.LOW), "concat(location, ':', r.line_no)")
        hits.append(f"CASE WHEN r.dep <> '' AND {python_loose('r.requirement', 'r.dep')} THEN {found} END")
    if D5 in detectors:
        own = f"array_contains({sql.array(fv.SDK_PACKAGES)}, lower(r.dep))"
        hits.append(f"CASE WHEN {own} THEN {_sdk_hit('lower(r.dep)')} END")
    return f"coalesce(flatten(transform({kept}, r -> {collected(hits)})), {_NO_HITS})"


def _requirement_findings(files: DataFrame, detectors: Collection[str]) -> DataFrame:
    kept = _requirement_files(files).select("target", "location", requirements(F.col("content")).alias("kept"))
    return kept.select("target", F.inline(F.expr(requirement_hits("kept", detectors))))


def _launch(config: Column) -> Column:
    """How a server is started: command and arguments, else its address."""
    arguments = _member(config, "args")
    spelled = F.transform(arguments.try_cast("array<variant>"), as_text)
    letters = F.when(F.schema_of_variant(arguments) == "STRING", F.split(F.try_variant_get(arguments, "$", "string"), ""))
    parts = F.concat(
        F.array(F.coalesce(as_text(_member(config, "command")), F.lit(""))),
        F.coalesce(F.when(present(arguments), F.coalesce(spelled, letters)), F.array().cast("array<string>")),
    )
    command = strip(F.array_join(F.filter(parts, lambda p: p != ""), " "))
    url = F.when(present(_member(config, "url")), as_text(_member(config, "url")))
    return F.when(_as_map(config).isNotNull(), F.coalesce(F.nullif(command, F.lit("")), url))


def servers(document: Column) -> Column:
    """``array<struct<server, launch>>`` that a client config declares."""
    declared = F.when(present(_member(document, "mcpServers")), _member(document, "mcpServers")).otherwise(
        _member(document, "servers")
    )
    return F.transform(_entries(_as_map(declared)), lambda e: F.struct(e["key"].alias("server"), _launch(e["value"]).alias("launch")))


def server_hits(declared: str) -> str:
    """Hits of an ``array<struct<server, launch>>`` in a row with a ``location``."""
    found = _inventory_hit(
        "concat('Config declares tool server ', s.server)",
        f"concat(s.server, ': ', coalesce(s.launch, {sql.quoted(fv.EV_NO_COMMAND)}))",
        "Check that somebody knows and trusts this server.",
    )
    return f"coalesce(transform({declared}, s -> {found}), {_NO_HITS})"


def _declared_server_findings(files: DataFrame) -> DataFrame:
    configs = _json_manifests(files, fv.CLIENT_CONFIG_NAMES)
    declared = configs.select("target", "location", servers(F.col("document")).alias("declared"))
    return declared.select("target", F.inline(F.expr(server_hits("declared"))))


def declared_servers(files: DataFrame) -> DataFrame:
    """``(target, location, evidence)`` inventory of servers wired up by client configs."""
    return _declared_server_findings(files).select("target", "location", "evidence")


def manifest_findings(files: DataFrame, detectors: Collection[str] = (D4, D5)) -> DataFrame:
    """Findings of the chosen detectors on package manifests and client configs."""
    rows = npm_rows(_json_manifests(files, ["package.json"]), detectors).unionByName(pyproject_rows(files, detectors))
    if D4 in detectors:
        rows = with_lockfile_hits(rows, files)
    found = rows.select("target", F.inline("hits")).unionByName(_requirement_findings(files, detectors))
    if D5 in detectors:
        found = found.unionByName(_declared_server_findings(files))
    return found


def supply_chain_findings(files: DataFrame) -> DataFrame:
    return manifest_findings(files, [D4])


def inventory_findings(files: DataFrame) -> DataFrame:
    return manifest_findings(files, [D5])
