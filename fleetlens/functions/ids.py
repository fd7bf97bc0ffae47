"""Identifiers: UUIDs kept as canonical lower-case text, and compound keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name space that object uids are hashed in, and the accepted UUID spellings.
OBJECT_NAMESPACE = "3f249403-2bb0-428f-8e91-504d1fd7ddb6"
_HYPHENATED = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
UUID_PATTERN = rf"^(?:(?:(?i:urn:uuid:))?{_HYPHENATED}|\{{{_HYPHENATED}\}}|[0-9a-fA-F]{{32}})$"


def _hyphenate(hex32: Column) -> Column:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, start, size) for start, size in parts])


def uuid5(space: Column, text: Column) -> Column:
    """Name-based SHA-1 UUID of ``text`` within the UUID ``space`` (RFC 4122, version 5)."""
    name_bytes = F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), F.encode(text, "UTF-8"))
    # Shaped inside a lambda, so that the digest is computed once and not once per piece.
    return F.get(F.transform(F.array(F.sha1(name_bytes)), _version5), F.lit(0))


def _version5(digest: Column) -> Column:
    # The variant digit keeps its two low bits under the fixed bits 10xx.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def ensure_uuid(uid: Column) -> Column:
    """A uid that already is a UUID stays (canonical form); any other text is hashed into one."""
    kept = _hyphenate(F.lower(F.regexp_replace(uid, r"(?i)^urn:uuid:|[{}-]", "")))
    return F.when(uid.rlike(UUID_PATTERN), kept).otherwise(uuid5(F.lit(OBJECT_NAMESPACE), uid))


def metric_key(entity: Column, timestamp: Column, category: Column, name: Column) -> Column:
    """Key of one metric point as a struct, so no separator can make two keys collide."""
    return F.struct(
        entity.alias("entity_uuid"), timestamp.alias("timestamp"), category.alias("category"), name.alias("name")
    )
