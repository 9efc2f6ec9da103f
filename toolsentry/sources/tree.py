"""Directory trees as a files table.

Spark's file sources hide names that begin with ``_`` or ``.``, which an audit must see, so trees are walked by tasks
instead. ``spark.read.format("audit_tree")`` reads roots given by path: one partition for each folder below a root, with
filters on ``role`` and ``name`` pushed into the walk, so that only wanted files are opened. ``read_trees`` does the same for a
table of targets of any length: one pass lists paths, the paths are dealt evenly over all tasks, and a second pass reads
contents. Both list what could not be read (``tree_rows``, ``unread``), and ``with_read_errors`` takes a target with
such paths its grade.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from toolsentry import fixed_values as fv
from toolsentry.schemas import FILES
from toolsentry.sources.files import as_files
from toolsentry.sources.lists import allowlist_from_lines

TREE_ROWS = f"{FILES}, error STRING, ignored_bytes BIGINT, read_as STRING"

_PRUNED = frozenset(fv.PRUNED_DIRS)
_CONFIGS = frozenset(fv.CONFIG_NAMES)
_LOCKS = frozenset(fv.NPM_LOCKFILES + fv.PYTHON_LOCKFILES)
_BATCH_BYTES = 16 * 1024 * 1024


def role_of(name: str) -> str:
    """The role of a file by its name, as ``classify`` says it of a column."""
    if name in _CONFIGS:
        return "config"
    if name in _LOCKS:
        return "lock"
    return "source" if os.path.splitext(name)[1].lower() in fv.SOURCE_EXTENSIONS else "other"


def walk(root: str, below: str = "", deep: bool = True) -> Iterator[tuple[str, str | None]]:
    """``(path, error)`` of the wanted files below a folder of a root, and of folders that can't be listed."""
    failed: list[OSError] = []
    for folder, subfolders, names in os.walk(os.path.join(root, below) if below else root, onerror=failed.append):
        subfolders[:] = sorted(d for d in subfolders if d not in _PRUNED) if deep else []
        for name in sorted(names):
            full = os.path.join(folder, name)
            if role_of(name) != "other" and os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), None
    for problem in failed:
        yield os.path.relpath(problem.filename or root, root).replace(os.sep, "/"), problem.strerror or "unreadable"


def decode(data: bytes) -> tuple[str, int]:
    """Text of a file and how many of its bytes are no UTF-8 and were left out; every newline spelling is one line feed."""
    text = data.decode("utf-8", "ignore")
    return text.replace("\r\n", "\n").replace("\r", "\n"), len(data) - len(text.encode())


def contents(root: str, path: str) -> tuple[str | None, str | None, int, str | None]:
    """``(content, error, ignored bytes, lossless text)``: the lossless text, given where bytes were left out, spells each of
    them as ``\\xnn``, so that none is lost without trace. Lockfiles are not opened."""
    name = PurePath(path).name
    if name in _LOCKS:
        return None, None, 0, None
    try:
        with open(os.path.join(root, path), "rb") as handle:
            data = handle.read()
    except OSError as problem:
        return None, problem.strerror or "unreadable", 0, None
    text, ignored = decode(data)
    return text, None, ignored, data.decode("utf-8", "backslashreplace") if ignored else None


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [(None, None, None) if data is None else (*decode(data), data) for data in batch["bytes"]]
        yield batch.assign(
            content=[text for text, *_ in read], ignored_bytes=[ignored for _, ignored, _ in read],
            read_as=[data.decode("utf-8", "backslashreplace") if ignored else None for _, ignored, data in read],
        )[["target", "path", "content", "ignored_bytes", "read_as"]]


def decoded(raw: DataFrame) -> DataFrame:
    """``(target, path, content, ignored_bytes, read_as)`` of landed ``(target, path, bytes)``, read as files of a tree are.

    ``content`` lacks bytes that are no UTF-8, ``ignored_bytes`` counts them, and ``read_as`` spells them out (null if there are
    none). Null bytes stay null.
    """
    kinds = "target STRING, path STRING, content STRING, ignored_bytes BIGINT, read_as STRING"
    return raw.select("target", "path", "bytes").mapInPandas(_decoded, kinds)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for target in batch.target:
            paths = walk(target)
            while part := list(itertools.islice(paths, 10_000)):
                yield pd.DataFrame(part, columns=["path", "error"]).assign(target=target)[["target", "path", "error"]]


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        errors = [None if os.path.isdir(t) and os.access(t, os.R_OK | os.X_OK) else "not a readable folder" for t in batch.target]
        yield batch.assign(error=errors)


def _root_lines(name: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target in batch.target:
                try:
                    with open(os.path.join(target, name), encoding="utf-8", errors="ignore") as handle:
                        while part := list(itertools.islice(handle, 10_000)):
                            yield pd.DataFrame({"target": target, "value": part})
                except OSError:
                    continue

    return read


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["target", "path", "location", "content", "error", "ignored_bytes", "read_as"]
    rows, size = [], 0
    for batch in batches:
        for target, path, error in zip(batch.target, batch.path, batch.error):
            content, problem, ignored, read_as = (None, error, 0, None) if error else contents(target, path)
            size += len(content or "") + len(read_as or "")
            rows.append((target, path, str(PurePath(target) / path), content, problem, ignored, read_as))
            if size > _BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def check_targets(targets: DataFrame) -> DataFrame:
    """``targets`` with an error for each path that is no readable folder, so that it gets no grade.

    ``read_trees`` gives no rows for such a target; only this tells it from a clean one.
    """
    unchecked = (F.col("kind") == "path") & F.col("error").isNull()
    paths = targets.filter(unchecked).select("target", "kind", F.lit("").alias("error"))
    checked = paths.mapInPandas(_check, "target STRING, kind STRING, error STRING")
    return checked.unionByName(targets.filter(~unchecked).select("target", "kind", "error"))


def read_root_allowlists(targets: DataFrame, name: str) -> DataFrame:
    """``(target, fingerprint)`` of the allowlist that each tree has at ``name``, a path below its root."""
    roots = targets.filter((F.col("kind") == "path") & F.col("error").isNull()).select("target").distinct()
    lines = roots.mapInPandas(_root_lines(name), "target STRING, value STRING")
    return allowlist_from_lines(lines, target=F.col("target"))


def tree_rows(targets: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every wanted file below each ``kind = 'path'`` target in the files schema, with what went wrong.

    ``error`` is set for files and folders that could not be read (``content`` is null then), ``ignored_bytes`` counts bytes
    that are no UTF-8 and so are not in ``content``, and ``read_as`` has the text of such files with those bytes spelled
    out. Target paths must be reachable from every executor.
    """
    roots = targets.filter((F.col("kind") == "path") & F.col("error").isNull()).select("target").distinct()
    paths = roots.mapInPandas(_list, "target STRING, path STRING, error STRING")
    spread = F.xxhash64("target", "path")
    dealt = paths.repartition(partitions, spread) if partitions else paths.repartition(spread)
    read = dealt.mapInPandas(
        _read, "target STRING, path STRING, location STRING, content STRING, error STRING, ignored_bytes BIGINT, read_as STRING")
    return as_files(read, "error", "ignored_bytes", "read_as")


def read_trees(targets: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sources, configs and lockfile names below each ``kind = 'path'`` target; what could not be read is in ``tree_rows``."""
    rows = tree_rows(targets, partitions)
    return rows.filter(F.col("error").isNull()).drop("error", "ignored_bytes", "read_as")


def unread(rows: DataFrame) -> DataFrame:
    """``(target, path, error)`` of the files and folders of ``tree_rows`` that could not be read."""
    return rows.filter(F.col("error").isNotNull()).select("target", "path", "error")


def ignored_bytes(rows: DataFrame) -> DataFrame:
    """``(target, path, ignored_bytes)`` of the files whose text lacks bytes that are no UTF-8."""
    return rows.filter(F.col("ignored_bytes") > 0).select("target", "path", "ignored_bytes")


def with_read_errors(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """``targets`` with an error for each target of which a file or folder could not be read: nothing unread is clean."""
    lost = unread(rows).groupBy("target").agg(F.count("*").alias("lost"), F.min(F.struct("path", "error")).alias("first"))
    said = F.concat(F.col("lost").cast("string"), F.lit(" paths could not be read, the first: "), "first.path", F.lit(": "), "first.error")
    return targets.join(lost, "target", "left").select("target", "kind", F.coalesce("error", said).alias("error"))


# -- the same as a data source ------------------------------------------------------------------------


@dataclass
class TreePart(InputPartition):
    """A folder of a root with all below it, or a root's own files alone."""

    root: str
    below: str
    deep: bool


class TreeReader(DataSourceReader):
    """Walks folders; filters on ``role``, ``name`` and ``target`` say which it walks, lists and opens.

    Folders that can't be listed are rows of the role ``unread``, files that can't be read rows of their role with an ``error``.
    """

    def __init__(self, roots: list[str]) -> None:
        self.roots = roots
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            column = one.attribute[0] if values is not None and len(one.attribute) == 1 else None
            if column in ("role", "name", "target"):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield one

    def partitions(self) -> list[TreePart]:
        parts = []
        for root in self.roots:
            if "target" in self.wanted and root not in self.wanted["target"]:
                continue
            parts.append(TreePart(root, "", False))
            try:
                with os.scandir(root) as entries:
                    folders = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in _PRUNED)
            except OSError:
                continue  # the root's own part lists the error
            parts += [TreePart(root, folder, True) for folder in folders]
        return parts

    def read(self, partition: TreePart) -> Iterator[tuple]:
        for path, error in walk(partition.root, partition.below, partition.deep):
            name = PurePath(path).name
            role = "unread" if error else role_of(name)
            if any(value not in self.wanted.get(column, {value}) for column, value in (("role", role), ("name", name))):
                continue
            content, problem, ignored, read_as = (None, error, 0, None) if error else contents(partition.root, path)
            location = str(PurePath(partition.root) / path)
            yield (partition.root, path, name, os.path.splitext(name)[1].lower(), role, location, content, problem, ignored, read_as)


class TreeSource(DataSource):
    """``spark.read.format("audit_tree").load(root)``, or with all roots as a JSON list in the option ``roots``."""

    @classmethod
    def name(cls) -> str:
        return "audit_tree"

    def schema(self) -> str:
        return TREE_ROWS

    def reader(self, schema: StructType) -> TreeReader:
        roots = json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]
        return TreeReader([root.rstrip("/") or "/" for root in roots])


def register_tree_source(spark: SparkSession) -> None:
    """Make ``audit_tree`` known to a session."""
    spark.dataSource.register(TreeSource)
