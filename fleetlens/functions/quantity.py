"""Resource quantities such as ``250m``, ``0.5``, ``512Mi`` or ``1e3``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How many milli-units one unit of each suffix is worth.
MILLI_PER_SUFFIX = {
    "m": 1,
    "": 1000,
    "k": 1000**2,
    "M": 1000**3,
    "G": 1000**4,
    "T": 1000**5,
    "P": 1000**6,
    "E": 1000**7,
    "Ki": 1000 * 1024,
    "Mi": 1000 * 1024**2,
    "Gi": 1000 * 1024**3,
    "Ti": 1000 * 1024**4,
    "Pi": 1000 * 1024**5,
    "Ei": 1000 * 1024**6,
}
# Parts of a milli-unit.
SUFFIX_PER_MILLI = {"u": 1000, "n": 1000**2}

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_PATTERN = rf"^({_NUMBER}(?:[eE][+-]?[0-9]+)?)([numkMGTPE]|[KMGTPE]i)?$"
_FACTORS = "map({})".format(", ".join(
    [f"'{name}', CAST({factor} AS DECIMAL(22,0))" for name, factor in MILLI_PER_SUFFIX.items()]))
_PARTS = "map({})".format(", ".join([f"'{name}', CAST({n} AS DECIMAL(7,0))" for name, n in SUFFIX_PER_MILLI.items()]))


def _milli(text: Column) -> Column:
    # The bare suffix E is exa, but E followed by digits is an exponent; the greedy number takes the exponent first.
    # A text that does not fit gives an empty number, hence NULL.
    number = F.regexp_extract(text, _PATTERN, 1).try_cast("decimal(25,9)")
    suffix = F.regexp_extract(text, _PATTERN, 2)
    return F.coalesce(
        F.try_multiply(number, F.try_element_at(F.expr(_FACTORS), suffix)),
        F.try_divide(number, F.try_element_at(F.expr(_PARTS), suffix)),
    ).cast("decimal(38,6)")


def quantity_milli(text: Column) -> Column:
    """Milli-units, rounded up; NULL for NULL, malformed or too large input."""
    return F.ceil(_milli(text)).try_cast("bigint")


def quantity_value(text: Column) -> Column:
    """Whole units, rounded up."""
    return F.ceil(_milli(text) / F.lit(1000).cast("decimal(4,0)")).try_cast("bigint")


def set_quantity_milli(text: Column) -> Column:
    """As :func:`quantity_milli`, but a zero quantity counts as not set."""
    return F.nullif(quantity_milli(text), F.lit(0).cast("bigint"))
