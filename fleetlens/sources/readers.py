"""Inputs: snapshots, change feeds, samples, logs, incidents, rules and configuration, as JSON or Parquet files.

Every reader states its schema, so no file is scanned to infer one; ``stream=True`` gives the streaming twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.functions.ids import ensure_uuid
from fleetlens.operators.alerts import parse_rules
from fleetlens.operators.samples import series_id
from fleetlens.sources.tables import Snapshot, Transaction


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, stream: bool, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema).format(fmt)
    return reader.options(**options).load(path)


def read_snapshot(spark: SparkSession, path: str, kind: str, fmt: str = "json", stream: bool = False, **options) -> DataFrame:
    """Full list of one kind of object."""
    return _read(spark, path, schemas.kind_schema(kind), fmt, stream, **options)


def read_changes(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False, **options) -> DataFrame:
    """ADDED / UPDATED / DELETED feed; the object travels as JSON text."""
    return _read(spark, path, schemas.feed_schema("change"), fmt, stream, **options)


def read_changes_topic(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """The same feed from a topic with JSON values (needs the Kafka connector on the class path)."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.feed_schema("change")).alias("c")).select("c.*")


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Metric samples with their label map; adds ``cluster_uuid``."""
    return with_cluster(_read(spark, path, schemas.feed_schema("sample"), fmt, stream, **options))


def append_samples(transaction: Transaction, samples: DataFrame) -> None:
    """Store metric samples: new label sets go to the dictionary ``series``, what was measured to ``sample``, which is laid
    out by day and metric and carries the 128-bit id in the place of the labels."""
    named = samples.withColumn("series_id", series_id(F.col("labels")))
    known = transaction.snapshot.read("series")
    seen = named.select("cluster_uuid", "series_id", "labels").dropDuplicates(["cluster_uuid", "series_id"])
    if known is not None:
        seen = seen.join(known, ["cluster_uuid", "series_id"], "left_anti")
    transaction.write_upsert("series", seen.withColumn("labels", F.map_entries("labels")))
    transaction.append("sample", named.select("cluster_uuid", "series_id", "metric", "ts", "value"))


def stored_samples(snapshot: Snapshot, metrics: list[str] | None = None, since=None, until=None) -> tuple[DataFrame, DataFrame] | None:
    """(samples, dictionary) from the store, of some metrics and a range of time; other days and metrics are not opened."""
    samples, series = snapshot.read("sample"), snapshot.read("series")
    if samples is None or series is None:
        return None
    if metrics is not None:
        samples = samples.filter(F.col("metric").isin(list(metrics)))
    for bound, inside in ((since, lambda column, limit: column >= limit), (until, lambda column, limit: column <= limit)):
        if bound is not None:
            limit = F.lit(bound).cast("timestamp")
            samples = samples.filter(inside(F.col("ts"), limit) & inside(F.col("_day"), F.to_date(limit)))
    return samples.drop("_day"), series.withColumn("labels", F.map_from_entries("labels"))


def read_logs(spark: SparkSession, path: str, since=None, fmt: str = "parquet", stream: bool = False, **options) -> DataFrame:
    """Log lines, only those after ``since`` when given."""
    lines = _read(spark, path, schemas.feed_schema("log_line"), fmt, stream, **options)
    return lines if since is None else lines.filter(F.col("ts") > F.lit(since).cast("timestamp"))


def read_incidents(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Open incidents with the tags of their object as columns."""
    return _read(spark, path, schemas.feed_schema("incident"), fmt, False, **options).select("object_tags.*")


def read_rules(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Rules with their parsed filter."""
    return parse_rules(_read(spark, path, schemas.feed_schema("rule"), fmt, False, **options))


def read_config(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    return with_cluster(_read(spark, path, schemas.feed_schema("config"), fmt, False, **options))


def with_cluster(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster_uuid", ensure_uuid(F.col("cluster_uid")))


def warm_keys(table: DataFrame, cluster_uuid: str) -> DataFrame:
    """Stored keys of one cluster: key (namespace/name) and uuid."""
    key = F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat("namespace", F.lit("/"), "name"))
    return table.filter(F.col("cluster_uuid") == cluster_uuid).select(key.alias("key"), "uuid")
