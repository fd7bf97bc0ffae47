"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Needed for right results: UTC instants, and replacing only the partitions a write touches.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: Rows that come sorted by the keys they are grouped by are gathered in that order, not hashed and sorted once more.
GROUPING_CONF = {"spark.sql.execution.replaceHashWithSortAgg": "true"}

#: Whether Spark deletes a query's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Needed for speed at scale: runtime re-planning, skewed-partition splitting, bounded broadcasts.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Recording the call site of every expression makes building wide plans several times slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on, and how sorted rows are grouped, to an existing session."""
    for key, value in {**REQUIRED_CONF, **GROUPING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the library's settings; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING_CONF, **REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs meanwhile go when it ends, not when the driver happens to collect garbage: a write
    runs once, so nothing reads them again."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on one machine (tests)
    a temporary folder becomes the session's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()
