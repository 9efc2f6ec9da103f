"""Documents as files of their own, all visible at once.

Tasks write each document to a file in a folder of their attempt. When all have succeeded, the driver moves one folder for each
task into a new version and points ``CURRENT`` at it, by renames; a reader sees the version before or the new one, never a
part. Folders of attempts that failed, or ran twice, are in no version. Paths must be reachable by all executors and
the driver. For very many targets ``reports.write_documents`` keeps the number of files fixed.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER = "CURRENT"
DOCUMENTS = "target STRING, part BIGINT, parts BIGINT, document STRING"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's successful attempt and how many documents it holds."""

    folder: str
    documents: int


def file_name(target: str, part: int) -> str:
    return f"{hashlib.sha256(target.encode()).hexdigest()[:16]}-{part:06d}.json"


class DocumentsWriter(DataSourceWriter):
    """Writes ``(target, part, parts, document)`` rows; the object travels to the tasks, so all of them know the job."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        self.attempts = os.path.join(path, f"_attempts-{self.job}")
        os.makedirs(self.attempts, exist_ok=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = os.path.join(self.attempts, uuid.uuid4().hex)
        os.mkdir(folder)  # fails once the job is over, so a task that is ended late leaves nothing behind
        count = 0
        with open(os.path.join(folder, "index.jsonl"), "w", encoding="utf-8") as index:
            for row in iterator:
                name = file_name(row.target, row.part)
                with open(os.path.join(folder, name), "w", encoding="utf-8") as handle:
                    handle.write(row.document)
                index.write(json.dumps({"target": row.target, "part": row.part, "parts": row.parts, "file": name}) + "\n")
                count += 1
        return Written(folder, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = os.path.join(self.attempts, "whole")
        os.makedirs(staged)
        for number, message in enumerate(m for m in messages if isinstance(m, Written) and m.documents):
            os.rename(message.folder, os.path.join(staged, f"task-{number:06d}"))
        os.rename(staged, os.path.join(self.path, f"version-{self.job}"))
        before = current_version(self.path)
        pointer = os.path.join(self.path, f"{POINTER}.{self.job}")
        with open(pointer, "w", encoding="utf-8") as handle:
            handle.write(f"version-{self.job}")
        os.replace(pointer, os.path.join(self.path, POINTER))
        self._clear()
        # the version before stays for those who are reading it; older ones go
        for name in os.listdir(self.path):
            if name.startswith("version-") and name not in (before, f"version-{self.job}"):
                shutil.rmtree(os.path.join(self.path, name), ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove all attempts. Under another name first, where tasks that still run find no folder to write into."""
        ended = f"{self.attempts}-ended"
        try:
            os.rename(self.attempts, ended)
        except FileNotFoundError:
            return
        shutil.rmtree(ended, ignore_errors=True)


class DocumentsSource(DataSource):
    """``documents.write.format("audit_documents").mode("overwrite").save(path)``: replaces what readers see."""

    @classmethod
    def name(cls) -> str:
        return "audit_documents"

    def schema(self) -> str:
        return DOCUMENTS

    def writer(self, schema: StructType, overwrite: bool) -> DocumentsWriter:
        if not overwrite:
            raise ValueError("audit_documents writes whole versions: use mode('overwrite')")
        return DocumentsWriter(self.options["path"])


def current_version(path: str) -> str | None:
    """The folder that holds the documents readers should see."""
    try:
        with open(os.path.join(path, POINTER), encoding="utf-8") as handle:
            return handle.read().strip()
    except FileNotFoundError:
        return None


def write_document_files(documents: DataFrame, path: str) -> None:
    """Replace the documents at ``path`` by these, at once."""
    spark = documents.sparkSession
    spark.dataSource.register(DocumentsSource)
    documents.select("target", "part", "parts", "document").write.format("audit_documents").mode("overwrite").save(path)


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """``(target, part, parts, document)`` of the current version."""
    version = current_version(path)
    if version is None:
        return spark.createDataFrame([], DOCUMENTS)
    folder = os.path.join(path, version)
    index = spark.read.schema("target STRING, part BIGINT, parts BIGINT, file STRING").json(f"{folder}/*/index.jsonl")
    found = spark.read.text(f"{folder}/*/*.json", wholetext=True).selectExpr("value AS document", "substring_index(_metadata.file_path, '/', -1) AS file")
    return index.join(found, "file").select("target", "part", "parts", "document")
