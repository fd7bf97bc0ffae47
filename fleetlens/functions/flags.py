"""Bit masks and default values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of each volume access mode.
ACCESS_MODE_BITS = {
    "ReadWriteOnce": 1,
    "ReadOnlyMany": 2,
    "ReadWriteMany": 4,
    "ReadWriteOncePod": 8,
}

# What an unset field of an object means.
DEFAULTS = {
    "allocate_load_balancer_node_ports": True,
    "internal_traffic_policy": "Cluster",
    "volume_mode": "Filesystem",
    "claim_retention_policy": "Retain",
}


def has_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(flag) != 0


def set_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseOR(flag)


def clear_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(~flag)


def toggle_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseXOR(flag)


def null_if_zero(mask: Column) -> Column:
    return F.nullif(mask, F.lit(0))


def access_modes(modes: Column) -> Column:
    """Bit mask of a list of access modes; unknown modes set no bit, an empty mask is NULL."""
    masks = [
        F.when(F.array_contains(modes, mode), F.lit(bit)).otherwise(F.lit(0)) for mode, bit in ACCESS_MODE_BITS.items()
    ]
    union = masks[0]
    for mask in masks[1:]:
        union = union.bitwiseOR(mask)
    return null_if_zero(F.when(modes.isNotNull(), union))


def yn(flag: Column) -> Column:
    """A flag that is not set is false."""
    return F.coalesce(flag, F.lit(False))


def or_default(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(DEFAULTS[name]))


def zero_if_null(count: Column, type_: str = "int") -> Column:
    return F.coalesce(count, F.lit(0)).cast(type_)
