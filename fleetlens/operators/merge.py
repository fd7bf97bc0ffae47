"""Keyed changes of whole tables as DataFrame operators; the stored tables apply them to the buckets a batch touches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order`` (NULL comes first).

    Spark limits each key to one row per task before the shuffle (window group limit), so a key holding a large share
    of all rows costs no more than any other.
    """
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_place", F.row_number().over(latest)).filter("_place = 1").drop("_place")


def dedup_rows(df: DataFrame) -> DataFrame:
    """One of each set of fully equal rows."""
    return df.dropDuplicates()


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; ``new`` holds each key once."""
    untouched = old.join(new.select(*keys), keys, "left_anti")
    return untouched.select(*old.columns).unionByName(new.select(*old.columns))


def merge_columns(old: DataFrame, new: DataFrame, keys: list[str], update_columns: list[str]) -> DataFrame:
    """Upsert that changes only ``update_columns`` of rows already present; unknown keys are inserted whole."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    arrived, known = F.col("n._new").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()

    def pick(column: str) -> Column:
        take_new = arrived if column in update_columns or column in keys else arrived & ~known
        return F.when(take_new, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column)

    return joined.select(*[pick(c) for c in old.columns])


def without_keys(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``ids`` (a one-column DataFrame). Small id sets are broadcast by size."""
    wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    return df.join(wanted, column, "left_anti").select(*df.columns)


def cascade_without(tables: dict[str, DataFrame], parent: str, ids: DataFrame, registry) -> dict[str, DataFrame]:
    """The parent table and its cascading children without the given parents, one level deep."""
    result = {parent: without_keys(tables[parent], ids, "uuid")}
    for relation in registry.children(parent, cascade_only=True):
        if relation.child in tables:
            result[relation.child] = without_keys(tables[relation.child], ids, relation.foreign_key)
    return result


def horizon(as_of, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def unexpired(df: DataFrame, column: str, as_of, days: int = 1) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; a plain comparison, so it reaches the scan."""
    return df.filter(F.col(column) >= horizon(as_of, days))


def expired_batch(df: DataFrame, column: str, as_of, days: int, size: int, tie: list[str]) -> DataFrame:
    """One bounded round of expired rows, oldest first (the rows a single delete statement takes)."""
    old = df.filter(F.col(column) < horizon(as_of, days))
    return old.orderBy(column, *tie).limit(size)


def replace_slice(config: DataFrame, cluster_uuid: str, key_prefix: str, rows: DataFrame | None) -> DataFrame:
    """Configuration of one cluster under a key prefix: locked entries go, given rows come in their place.

    Given rows win over unlocked entries of the same key; without rows the unlocked entries stay as they are.
    """
    in_slice = (F.col("cluster_uuid") == cluster_uuid) & F.col("key").startswith(key_prefix)
    kept = config.filter(~(in_slice & F.col("locked")))
    return kept if rows is None else merge_rows(kept, rows, ["key", "cluster_uuid"])


def config_pivot(config: DataFrame, key_prefix: str, keys: list[str]) -> DataFrame:
    """One record per cluster with a column per key (named without the prefix)."""
    picked = config.filter(F.col("key").startswith(key_prefix))
    return picked.groupBy("cluster_uuid").agg(*[
        F.max(F.when(F.col("key") == key_prefix + key, F.col("value"))).alias(key) for key in keys
    ])


def latest_by(df: DataFrame, order: str) -> DataFrame:
    """The one row with the highest ``order``."""
    return df.orderBy(F.col(order).desc()).limit(1)


def instance_latest(heartbeats: DataFrame) -> DataFrame:
    """Newest instance row per cluster; version and time of the last answer survive while the API is down.

    ``heartbeats``: uuid, cluster_uuid, version, kubernetes_version (NULL when not reachable), reachable, message,
    heartbeat.
    """
    reached = F.col("kubernetes_version").isNotNull()
    current = F.struct("uuid", "version", "reachable", "message")
    return (
        heartbeats.groupBy("cluster_uuid")
        .agg(
            F.max_by(current, "heartbeat").alias("_now"),
            F.max_by(F.when(reached, F.col("kubernetes_version")), F.when(reached, F.col("heartbeat"))).alias("kubernetes_version"),
            F.max(F.when(reached, F.col("heartbeat"))).alias("kubernetes_heartbeat"),
            F.max("heartbeat").alias("heartbeat"),
        )
        .select(
            "_now.uuid", "cluster_uuid", "_now.version", "kubernetes_version", "kubernetes_heartbeat",
            F.col("_now.reachable").alias("kubernetes_api_reachable"), "_now.message", "heartbeat",
        )
    )


def fan_in(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """Several inputs as one stream of rows, each carrying where it came from."""
    merged = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def as_timestamp(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
