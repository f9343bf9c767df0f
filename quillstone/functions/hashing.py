"""Content hashes, record ids and hashed dice: the same value on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import similarity_text


def content_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def short_sha1(x: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(x), 1, n)


def duplicate_key(x: Column) -> Column:
    """SHA-1 of the first 5000 characters of the normalised text."""
    return F.sha1(F.substring(similarity_text(x), 1, 5000))


def record_id(kind: str, source: Column, key: Column, index: Column | None = None) -> Column:
    parts = [F.lit(kind), source, key] + ([F.lpad(index.cast("string"), 4, "0")] if index is not None else [])
    return F.concat_ws(":", *parts)


def unsigned64(hex16: Column) -> Column:
    """A hash prefix of 16 hex digits as an exact decimal."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def die(seed: Column, namespace: Column, index: Column, sides: Column) -> Column:
    """One roll: the first 8 bytes of sha256('seed:namespace:index') modulo sides, plus 1."""
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), namespace, index.cast("string")), 256)
    return (unsigned64(F.substring(digest, 1, 16)) % sides.cast("decimal(20,0)")).cast("long") + 1


def stable_choice(options: Column, key: Column) -> Column:
    """The option that the first byte of sha256(key) picks."""
    byte = F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int")
    return F.element_at(options, byte % F.size(options) + 1)
