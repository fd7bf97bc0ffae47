"""Small derivations from the fields of one object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_roles(labels: Column) -> Column:
    """What follows the first slash of each ``node-role`` label, joined in text order."""
    keys = F.filter(F.map_keys(labels), lambda key: key.contains("node-role") & key.contains("/"))
    # Only the piece up to a second slash counts, the slash included.
    roles = F.transform(keys, lambda key: F.regexp_extract(key, "^[^/]*/([^/]*/?)", 1))
    return F.coalesce(F.array_join(F.array_sort(roles), ", "), F.lit(""))


def first_set_member(members: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Name and JSON text of the first member that is not NULL; both NULL when none is."""
    name = F.coalesce(*[F.when(column.isNotNull(), F.lit(label)) for label, column in members])
    text = F.coalesce(*[F.to_json(column) for _, column in members])
    return name, text


def first_map_entry(source: Column) -> tuple[Column, Column]:
    """Type and text of a one-entry union that arrives as a map ``{type: json}``; empty text when nothing is set."""
    name, text = F.element_at(F.map_keys(source), 1), F.element_at(F.map_values(source), 1)
    some = F.coalesce(F.size(source), F.lit(0)) > 0
    return F.when(some, name).otherwise(""), F.when(some, text).otherwise("")


def first_seen(event_time: Column, first_timestamp: Column, created: Column) -> Column:
    return F.coalesce(event_time, first_timestamp, created)


def last_seen(series_time: Column, last_timestamp: Column, first: Column) -> Column:
    return F.coalesce(series_time, last_timestamp, first)


def occurrence_count(series_count: Column, old_count: Column) -> Column:
    return F.greatest(F.coalesce(series_count, F.lit(0)), F.coalesce(old_count, F.lit(0)), F.lit(1)).cast("int")


def alert_url(base: str, kind: Column, uuid: Column) -> Column:
    """Page of an object below the base address: kind without underscores, uuid as ``id``."""
    root = base.split("#")[0].split("?")[0]
    if not root.endswith("/"):
        root += "/"
    return F.concat(F.lit(root), F.replace(kind, F.lit("_"), F.lit("")), F.lit("?id="), uuid)


def resolve_url(base: str, reference: Column) -> Column:
    """A reference that carries its own scheme is kept; any other is placed below the base address."""
    root = base.split("#")[0].split("?")[0]
    if not root.endswith("/"):
        root += "/"
    relative = F.concat(F.lit(root), F.regexp_replace(reference, "^/+", ""))
    return F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference).otherwise(relative)
