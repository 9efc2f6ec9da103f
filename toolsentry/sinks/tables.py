"""Table sinks: findings, baselines and allowlists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolsentry.functions.text import sha256_prefix
from toolsentry.schemas import BASELINES


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Findings as they are, one row each; ``fmt`` is any Spark file format."""
    findings.write.format(fmt).mode(mode).save(path)


def label_key(label: Column) -> Column:
    """Short key of a target label, safe as a folder or partition name."""
    return sha256_prefix(label, 16)


def write_baseline(hashes: DataFrame, path: str, snapshot: str) -> None:
    """Store tool hashes as one snapshot. Writing a snapshot again replaces it."""
    (
        hashes.withColumn("label_key", label_key(F.col("target")))
        .withColumn("snapshot", F.lit(snapshot))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(path)
    )


def read_baseline(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """One snapshot of a baseline table, the newest by name if none is given; other snapshots are not read."""
    stored = spark.read.parquet(path)
    named = snapshot if snapshot is not None else stored.agg(F.max("snapshot")).first()[0]
    return stored.filter(F.col("snapshot") == F.lit(named))


BASELINE_KEY = ("target", "tool")
_INDEX = "snapshot STRING, buckets INT, folder STRING, written_at TIMESTAMP"


def write_bucketed_baseline(hashes: DataFrame, path: str, snapshot: str, buckets: int = 200) -> None:
    """Store tool hashes as a snapshot that is bucketed and sorted by target and tool.

    A comparison with it reads the stored side as it lies, without a shuffle; only the new side moves, to as many partitions
    as there are buckets. The snapshot is listed in an index once all its files are there, so a reader never finds a part;
    writing it again lists a newer one.
    """
    spark = hashes.sparkSession
    folder, name = f"{path}/data-{uuid.uuid4().hex}", f"baseline_{uuid.uuid4().hex}"
    # dealt as the buckets are, so each bucket is one file
    dealt = hashes.select("target", "tool", "def_hash", "captured_at").repartition(buckets, *BASELINE_KEY)
    writer = dealt.write.format("parquet").bucketBy(buckets, *BASELINE_KEY).sortBy(*BASELINE_KEY).option("path", folder)
    writer.saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table only the entry goes; the files stay
    row = spark.createDataFrame([(snapshot, buckets, folder)], "snapshot STRING, buckets INT, folder STRING")
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/index")


def read_bucketed_baseline(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """One snapshot of a bucketed baseline, the newest by name if none is given; nothing of the others is read."""
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    listed = index if snapshot is None else index.filter(F.col("snapshot") == F.lit(snapshot))
    last = listed.orderBy(F.col("snapshot").desc(), F.col("written_at").desc()).first()
    if last is None:
        raise ValueError(f"no snapshot {snapshot or ''} in {path}")
    name, key = f"baseline_{last.folder.rsplit('-', 1)[1]}", ", ".join(BASELINE_KEY)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({BASELINES}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
        f"INTO {last.buckets} BUCKETS LOCATION '{last.folder}'")
    return spark.table(name)


def new_allow_entries(entries: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Entries not yet on the allowlist, each once."""
    wanted, known = entries.select("target", "fingerprint").distinct().alias("n"), allowlist.alias("k")
    same = (F.col("n.fingerprint") == F.col("k.fingerprint")) & F.col("n.target").eqNullSafe(F.col("k.target"))
    return wanted.join(known, same, "left_anti")


def allow_add(entries: DataFrame, allowlist: DataFrame, path: str) -> None:
    """Append new entries to a stored allowlist; adding one twice changes nothing."""
    new_allow_entries(entries, allowlist).write.mode("append").parquet(path)
