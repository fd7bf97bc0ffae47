"""Outputs other than the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fleetlens.operators.alerts import alert_records
from fleetlens.sources.tables import Batch


def emit_alerts(alerts: DataFrame, path: str, batch: Batch | None = None, mode: str = "append") -> None:
    """Alert records as JSON lines.

    A batch has a folder of its own (feed, then number), so a batch that is repeated sends nothing twice: a folder that was
    written to its end is left as it is, file by file, one that was cut off is written anew.
    """
    spark = alerts.sparkSession
    if batch is not None:
        path = f"{path}/feed={batch.feed.replace('/', '-')}/batch={batch.id}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        mode = "overwrite"
    alert_records(alerts).write.mode(mode).option("ignoreNullFields", False).json(path)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Give the same rows to several sinks one after the other, computing them once.

    The first sink is the write that must succeed; an error in it stops the others.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def with_row_count(df: DataFrame, name: str):
    """Count the rows that pass through a write; read the number from the observation after the action."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
