"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stored log size in bytes per container.
MAX_LOG_BYTES = 65535

_REPLACEMENT = "�"
_STAND_IN = "\U0010ffff"


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def snake(text: Column) -> Column:
    """``ReplicaSet`` -> ``replica_set``."""
    return F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"))


def lower_pair(name: Column, value: Column) -> Column:
    """Lower-cased ``name:value``, the text a label is identified by."""
    return F.lower(F.concat(name, F.lit(":"), value))


def trim_stop(text: Column) -> Column:
    """Outer white space removed, then one full stop at the end removed."""
    return F.regexp_replace(text, r"(?U)^\s+|\.?\s*$", "")


def reason_message(reason: Column, message: Column) -> Column:
    """``reason: message``, or the reason alone when the trimmed message is empty."""
    told = null_if_empty(trim_stop(F.coalesce(message, F.lit(""))))
    return F.concat(F.coalesce(reason, F.lit("")), F.coalesce(F.concat(F.lit(": "), told), F.lit("")))


def join_list(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", ")


def object_name(namespace: Column, name: Column) -> Column:
    """``namespace/name``, or the bare name of an object outside any namespace."""
    return F.when(F.coalesce(namespace, F.lit("")) == "", name).otherwise(F.concat(namespace, F.lit("/"), name))


def drop_invalid_utf8(text: Column) -> Column:
    """Bytes that are no valid UTF-8 are left out; replacement characters of the text itself stay."""
    marked = F.replace(text, F.lit(_REPLACEMENT), F.lit(_STAND_IN))
    cleaned = F.replace(F.make_valid_utf8(marked), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(cleaned, F.lit(_STAND_IN), F.lit(_REPLACEMENT)))


def log_tail(text: Column, size: int = MAX_LOG_BYTES) -> Column:
    """The last ``size`` bytes of a text, beginning at a whole line.

    The cut moves forward to the start of a character (UTF-8 continuation bytes are skipped), then everything
    through the first line break goes, if there is one. A text that fits is returned unchanged.
    """
    valid = drop_invalid_utf8(text)
    raw = valid.cast("binary")
    length = F.octet_length(valid)
    cut = F.substring(raw, length - size + 1, F.lit(size))
    # A character has at most three continuation bytes: hex pairs 80 to BF.
    head = F.hex(F.substring(cut, 1, 3))
    skipped = (F.length(F.regexp_extract(head, "^((?:[89AB][0-9A-F])*)", 1)) / 2).cast("int")
    tail = F.substring(cut, skipped + 1, F.lit(size)).cast("string")
    line_break = F.instr(tail, "\n")
    whole_lines = F.when(line_break > 0, tail.substr(line_break + 1, F.length(tail))).otherwise(tail)
    return F.when(length <= size, valid).otherwise(whole_lines)
