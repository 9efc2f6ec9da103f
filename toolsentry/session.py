"""Session settings the engine relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # filters reach sources written in Python
    "spark.sql.python.filterPushdown.enabled": "true",
    # keyed state with timers; it lies on disk, so it may outgrow memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # repeated keys in manifests: the last one counts, as JSON readers do
    "spark.sql.variant.allowDuplicateKeys": "true",
    # sources travel to Python in batches of bounded bytes, whatever the file sizes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


#: The archive of each application; the folders last as long as this process, which serves them to executors.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers of an application, once; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="toolsentry-")
        copied = os.path.join(folder.name, "package", os.path.basename(package))
        shutil.copytree(package, copied, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder.name, "toolsentry"), "zip", os.path.dirname(copied)))


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above on a session and ship the package to its workers."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("toolsentry")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.files.maxPartitionBytes", "16m")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


#: The scratch folder of each local application that names none; it goes when this process ends.
_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a run's files below the shared folder ``spark.checkpoint.dir`` names.

    All folders of an application lie below one that bears its id, to be removed as one when nothing reads them any
    more. A local session without that setting gets a folder of its own that goes with this process; on a cluster the
    setting must be there, since executors do not share a machine's folders.
    """
    application = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors can reach")
        if application not in _scratch:
            _scratch[application] = tempfile.TemporaryDirectory(prefix="toolsentry-scratch-", ignore_cleanup_errors=True)
        shared = _scratch[application].name
    return os.path.join(shared, application, f"{name}-{uuid.uuid4().hex}")
