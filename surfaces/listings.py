"""Queries over lists, captures and keys: the small tables around an audit, planted in every row's own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaces import planted
from toolsentry import fixed_values as fv
from toolsentry.operators import drift
from toolsentry.operators.findings import finalize
from toolsentry.operators.lookalikes import lookalikes, typosquat_findings
from toolsentry.sinks import tables
from toolsentry.sources.files import as_files
from toolsentry.sources.lists import allow_union, allowlist_from_lines, targets_from_lines
from toolsentry.sources.tree import decoded
from toolsentry.sources.tools import as_tools, inspect_tools, tools_from_payload


def _lines(spark: SparkSession, sf_dir: str, options: list[str], mark: Column) -> DataFrame:
    """One line per document: an option with the document's mark in it."""
    documents = planted.read(spark, sf_dir, "documents")
    return documents.select("doc_id", "source", F.replace(planted.pick(options, "doc_id"), F.lit("{}"), mark).alias("value"))


def target_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_lines(_lines(spark, sf_dir, planted.TARGET_LINES, F.col("doc_id").cast("string")))


def _allow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, planted.ALLOW_LINES, F.substring(F.sha2("text", 256), 1, 12))


def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that holds everywhere and the lists of single targets, as one."""
    lines = _allow_lines(spark, sf_dir)
    everywhere = allowlist_from_lines(lines.filter("doc_id % 2 = 0"))
    return allow_union(everywhere, allowlist_from_lines(lines, target=F.col("source")))


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for all documents, in their target or everywhere, that are not on the list yet."""
    documents = planted.read(spark, sf_dir, "documents")
    owner = F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("target")
    wanted = documents.select(owner, F.substring(F.sha2("text", 256), 1, 12).alias("fingerprint"))
    return tables.new_allow_entries(wanted, allow_lists(spark, sf_dir))


def captured_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as JSON lines: with a target, as a protocol's reply without one, and cut off."""
    documents = planted.read(spark, sf_dir, "documents")
    first = F.struct(F.lit("first").alias("name"), F.col("text").alias("description"))
    second = F.struct(F.concat("lang", F.lit("_tool")).alias("name"), F.lit(None).cast("string").alias("description"))
    listed = F.array(first, second).alias("tools")
    named = F.to_json(F.struct(F.concat(F.lit("at_"), "source").alias("target"), listed))
    reply = F.to_json(F.struct(F.struct(listed).alias("result")))
    line = F.when(F.col("doc_id") % 3 == 0, named).when(F.col("doc_id") % 3 == 1, reply).otherwise(F.concat(F.lit("["), named))
    return as_tools(documents.select(*tools_from_payload(line, F.col("source")))).drop("captured_at")


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared tools as JSON lines, read back."""
    lines = inspect_tools(planted.tools(spark, sf_dir))
    field = lambda path: F.get_json_object("value", path)
    return lines.select("target", field("$.name").alias("tool"), field("$.description").alias("description"),
                        field("$.input_schema.properties.lang.description").alias("lang_text"))


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = planted.read(spark, sf_dir, "documents").select(F.col("source").alias("target")).distinct()
    return sources.select("target", tables.label_key(F.col("target")).alias("label_key"))


def newest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots in one history, and the newest hash of each tool."""
    captured = planted.snapshots(spark, sf_dir)
    early, late = (drift.baseline_hashes(captured.filter(c)) for c in (planted.before_cut(), ~planted.before_cut()))
    return drift.latest_baseline(early.unionByName(late))


def unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = planted.read(spark, sf_dir, "documents")
    path = F.concat(planted.pick(planted.PRUNED_PATHS, "doc_id"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".js"))
    return as_files(documents.select(F.col("source").alias("target"), path.alias("path"), F.col("text").alias("content"))).select("target", "path", "role")


def _words(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    return planted.read(spark, sf_dir, table).select(F.explode(words).alias("name"))


def lookalike_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations next to a dictionary of all words of documents."""
    return lookalikes(_words(spark, sf_dir, "conversations"), _words(spark, sf_dir, "documents"))


def typosquat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted manifests against a table of popular names and the sources' names."""
    sources = planted.read(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    popular = spark.createDataFrame([(n,) for n in fv.POPULAR_PACKAGES], "name string")
    found = finalize(typosquat_findings(planted.package_files(spark, sf_dir), popular.unionByName(sources)))
    return found.select("target", "rule_id", F.col("severity").cast("int").alias("severity"), "owasp_id", "confidence", "location", "evidence", "fingerprint")


def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of which some are no UTF-8: their text, and the files with bytes that were left out."""
    documents = planted.read(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    odd = planted.pick(planted.ODD_BYTES, "doc_id")
    raw = F.concat(F.lit(b"x\r\n"), F.unhex(odd), text, F.unhex(odd))
    files = decoded(documents.select(F.col("source").alias("target"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), raw.alias("bytes")))
    return files.select("target", "path", F.sha2("content", 256).alias("content_sha256"), "ignored_bytes", F.length("read_as").alias("lossless_chars"))


QUERIES = {
    "lookalike_words": lookalike_words,
    "typosquat_table": typosquat_table,
    "decoded_files": decoded_files,
    "target_list": target_list,
    "allow_lists": allow_lists,
    "allow_add_new": new_entries,
    "captured_tools": captured_tools,
    "inspect_tools": inspected,
    "label_keys": label_keys,
    "latest_baseline": newest_baseline,
    "prune_dirs": unpruned,
}
