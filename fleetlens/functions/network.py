"""Addresses and address ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BRACKETED = r"^\[([^\[\]]*)\]:[^:\[\]]*$"
_PLAIN = r"^([^:\[\]]*):[^:\[\]]*$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_CIDR4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}/(3[0-2]|[12]?[0-9])$"
_CIDR6 = r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*/(12[0-8]|1[01][0-9]|[1-9]?[0-9])$"
_LONG_MAX = 9223372036854775807


def host_of(instance: Column) -> Column:
    """Host of ``host:port`` or ``[v6]:port``; text without a colon is the host itself; NULL when malformed."""
    return (
        F.when(~instance.contains(":"), instance)
        .when(instance.rlike(_BRACKETED), F.regexp_extract(instance, _BRACKETED, 1))
        .when(instance.rlike(_PLAIN), F.regexp_extract(instance, _PLAIN, 1))
    )


def cidr_ips(cidr: Column, strict: bool = True) -> Column:
    """Usable addresses of a range: its size less two, 0 for an empty text.

    Ranges too large to count (31 or more host bits in IPv4, 127 or more in IPv6) have size 0; sizes beyond a
    long are capped. A malformed range fails the query, or gives NULL with ``strict=False``.
    """
    host_bits4 = 32 - F.regexp_extract(cidr, _CIDR4, 1).try_cast("int")
    host_bits6 = 128 - F.regexp_extract(cidr, _CIDR6, 1).try_cast("int")
    size4 = F.when(host_bits4 >= 31, F.lit(0).cast("bigint")).otherwise(F.pow(F.lit(2), host_bits4).cast("bigint"))
    size6 = (
        F.when(host_bits6 >= 127, F.lit(0).cast("bigint"))
        .when(host_bits6 >= 63, F.lit(_LONG_MAX))
        .otherwise(F.pow(F.lit(2), F.least(host_bits6, F.lit(62))).cast("bigint"))
    )
    bad = F.raise_error(F.concat(F.lit("malformed address range: "), cidr)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return (
        F.when(F.coalesce(cidr, F.lit("")) == "", F.lit(0).cast("bigint"))
        .when(cidr.rlike(_CIDR4), size4 - 2)
        .when(cidr.rlike(_CIDR6), size6 - 2)
        .otherwise(bad)
    )


def ip_families(families: Column) -> Column:
    """``DualStack``, ``IPv4``, ``IPv6`` or ``Unknown``; NULL when no family is listed."""
    v4, v6 = F.array_contains(families, "IPv4"), F.array_contains(families, "IPv6")
    named = F.when(v4 & v6, "DualStack").when(v4, "IPv4").when(v6, "IPv6").otherwise("Unknown")
    return F.when(F.coalesce(F.size(families), F.lit(0)) > 0, named)
