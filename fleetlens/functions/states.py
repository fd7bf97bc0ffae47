"""Health states: ordinals inside the engine, text at its edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States in order of weight, and the alert severity of each.
STATES = ["ok", "pending", "unknown", "warning", "critical"]
SEVERITIES = ["ok", "info", "err", "warning", "crit"]

OK, PENDING, UNKNOWN, WARNING, CRITICAL = range(5)


def _texts(values: list[str]) -> Column:
    return F.expr("array({})".format(", ".join(f"'{v}'" for v in values)))


def state_name(ordinal: Column) -> Column:
    return F.get(_texts(STATES), ordinal)


def severity(ordinal: Column) -> Column:
    return F.get(_texts(SEVERITIES), ordinal)


def severity_of_name(name: Column) -> Column:
    return severity((F.array_position(_texts(STATES), name) - 1).cast("int"))


def state_ordinal(name: Column) -> Column:
    return (F.array_position(_texts(STATES), name) - 1).cast("int")
