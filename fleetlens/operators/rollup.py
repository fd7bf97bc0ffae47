"""Aggregations over flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.states import OK, state_name

# Order in which the sorts of containers are listed in reasons.
SORT_ORDER = {"init": 0, "sidecar": 1, "main": 2}


def sort_rank(sort: Column) -> Column:
    rank = None
    for name, number in SORT_ORDER.items():
        rank = F.when(sort == name, number) if rank is None else rank.when(sort == name, number)
    return rank


def pod_resources(containers: DataFrame, columns: list[str]) -> DataFrame:
    """Per pod: sum over main containers, raised to the largest single init or sidecar container."""
    main = F.col("sort") == "main"
    return containers.groupBy("pod_uuid").agg(*[
        F.greatest(F.sum(F.when(main, F.col(c))), F.max(F.when(~main, F.col(c)))).alias(c) for c in columns
    ])


def container_rollup(containers: DataFrame) -> DataFrame:
    """Per pod: worst state, number not ok, running and total count, reasons in listing order.

    ``containers``: pod_uuid, sort, position, state (ordinal), reason. The reasons of one pod come from one object, so
    the list gathered per pod is bounded by the size of an object.
    """
    line = F.concat(F.lit("["), F.upper(state_name(F.col("state"))), F.lit("] "), F.col("reason"))
    item = F.struct(sort_rank(F.col("sort")).alias("rank"), F.col("position"), line.alias("line"))
    not_ok = F.count_if(F.col("state") != OK)
    total = F.count_if(F.col("sort") != "init")
    return containers.groupBy("pod_uuid").agg(
        F.max("state").alias("state"), not_ok.alias("not_ok"), (total - not_ok).alias("running"), total.alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("reasons"),
    )


def union_containers(by_sort: dict[str, DataFrame]) -> DataFrame:
    """Init, sidecar and main containers as one table with a ``sort`` column."""
    merged = None
    for sort, df in by_sort.items():
        part = df.withColumn("sort", F.lit(sort))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged


def incidents_by_kind(incidents: DataFrame) -> DataFrame:
    """Distinct open incidents of each kind, one row each: most may be of one kind, and a list would outgrow a task."""
    return incidents.select("resource", "uuid").distinct()


def favorites_of(favorites: DataFrame, username: str | None = None, kind: str | None = None) -> DataFrame:
    """Favourites by user, kind and priority (unset priorities last), optionally of one user or kind.

    A range-partitioned sort, so a user with very many favourites is spread over tasks.
    """
    picked = favorites
    if username is not None:
        picked = picked.filter(F.col("username") == username)
    if kind is not None:
        picked = picked.filter(F.col("kind") == kind)
    return picked.orderBy("username", "kind", F.col("priority").asc_nulls_last(), "resource_uuid")


def write_counts(changes: DataFrame) -> DataFrame:
    """Rows written and deleted per table."""
    return changes.groupBy("table").agg(
        F.count_if(F.col("type") != "DELETED").alias("written"), F.count_if(F.col("type") == "DELETED").alias("deleted"))
