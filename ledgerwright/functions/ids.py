"""Ids that a repeated task makes again: hashes of keys, version-5 UUIDs and note handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of URLs of RFC 4122.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def event_id(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def json_array(*columns) -> Column:
    """The strings as a compact JSON array."""
    return F.to_json(F.array(*[F.col(c) if isinstance(c, str) else c for c in columns]))


def uuid5_hex(name: Column, space: str = URL_SPACE) -> Column:
    """The 32 hex digits of the version-5 UUID of a name: SHA-1 over name space and name, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.lower(F.hex(variant.cast("long"))), F.substring(digest, 18, 15))


def note_id(*key) -> Column:
    """n_ and the URL-safe base64, without padding, of the version-5 UUID of the key as a JSON array."""
    return F.concat(F.lit("n_"), F.rtrim(F.translate(F.base64(F.unhex(uuid5_hex(json_array(*key)))), "+/", "-_"), F.lit("=")))


def normal_note_id(value) -> Column:
    """The handle without surrounding space, with its prefix; null unless 22 URL-safe characters follow."""
    bare = F.regexp_replace(F.trim(F.col(value) if isinstance(value, str) else value), "^n_", "")
    return F.when(bare.rlike("^[A-Za-z0-9_-]{22}$"), F.concat(F.lit("n_"), bare))
