"""Checks of produced tables against the catalogue of keys, domains and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas


def pk_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def _per_column(df: DataFrame, tests: dict) -> DataFrame:
    """One pass over the table; one output row per tested column with its number of bad rows."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("bad_rows")) for name in tests])
    return counts.select(F.inline(pairs))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, {c: F.col(c).isNull() for c in columns})


def enum_violations(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    return _per_column(df, {c: ~F.coalesce(F.col(c).isin(values), F.lit(True)) for c, values in domains.items()})


def length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    return _per_column(df, {c: F.coalesce(F.char_length(F.col(c)) > n, F.lit(False)) for c, n in limits.items()})


def orphan_children(child: DataFrame, foreign_key: str, parent: DataFrame) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(F.col("uuid").alias(foreign_key)), foreign_key, "left_anti").select(*child.columns)


def unused_labels(labels: DataFrame, resource_labels: DataFrame) -> DataFrame:
    """Labels no resource carries."""
    used = resource_labels.select(F.col("label_uuid").alias("uuid"))
    return labels.join(used, "uuid", "left_anti").select(*labels.columns)


def check_table(name: str, df: DataFrame) -> dict[str, DataFrame]:
    """All checks the catalogue knows for a table."""
    checks = {"primary_key": pk_violations(df, schemas.TABLE_KEYS[name])}
    if name in schemas.NOT_NULL:
        checks["not_null"] = null_violations(df, schemas.NOT_NULL[name])
    if name in schemas.DOMAINS:
        checks["domain"] = enum_violations(df, schemas.DOMAINS[name])
    if name in schemas.MAX_LENGTHS:
        checks["length"] = length_violations(df, schemas.MAX_LENGTHS[name])
    return checks
