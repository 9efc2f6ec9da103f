"""Names one edit away from a name of a dictionary of any size, by an equi-join.

Two names at edit distance one share a string that each is, or becomes by losing one character. So every distinct name is
looked up by its few such strings, and the pairs found are verified. Nothing is compared with the whole dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolsentry import fixed_values as fv
from toolsentry.functions.text import dependency_name
from toolsentry.operators import manifest_scan
from toolsentry.operators.hits import hit


def neighbourhood(name: Column) -> Column:
    """The name and what is left of it without one character, each once."""
    without = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))),
    )
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, without).otherwise(F.array().cast("array<string>"))))


def lookalikes(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(name, popular)``: each distinct ``name`` of ``names`` one edit from a ``name`` of ``dictionary``, and the
    alphabetically first of those. Null and empty names have none.

    Names meet in the strings of their neighbourhoods, of which a name has one more than characters; both sides are distinct before
    they are joined, and the smallest name is found before a pair is shuffled a second time.
    """
    asked, known = (t.select("name").filter(F.length("name") > 0).distinct() for t in (names, dictionary))
    a = asked.select("name", F.explode(neighbourhood(F.col("name"))).alias("part"))
    b = known.select(F.col("name").alias("popular"), F.explode(neighbourhood(F.col("name"))).alias("part"))
    near = a.join(b, "part").filter(F.levenshtein("name", "popular", 1) == 1)
    return near.groupBy("name").agg(F.min("popular").alias("popular"))


def typosquat_findings(files: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dependencies of package.json and pyproject.toml files that look like a name of the dictionary.

    The findings are those of the built-in list of popular names, with a table in its place: npm names as they are, Python
    names in lower case, one finding for a dependency of a file.
    """
    npm = manifest_scan.npm_deps(files).select("target", "path", F.col("dep").alias("name"))
    python = manifest_scan.pyproject_deps(files).select("target", "path", F.lower(dependency_name(F.col("requirement"))).alias("name"))
    printed = files.filter(F.col("role") == "config").select("target", "path", "location")
    named = npm.unionByName(python).join(printed, ["target", "path"])
    found = named.join(lookalikes(named, dictionary), "name")
    said = hit(
        manifest_scan.D4, "'D4-TYPOSQUAT'", "concat('Dependency ', name, ' is one edit from ', popular)", fv.MEDIUM,
        manifest_scan.HYGIENE_OWASP_ID, "'low'", "concat(name, ' vs ', popular)", "Make sure the intended package is meant.",
        "concat(location, ' :: ', name)",
    )
    return found.select("target", F.inline(F.expr(f"array({said})")))
