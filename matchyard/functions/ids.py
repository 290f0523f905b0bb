"""Identities that depend on their key alone, and content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name space of the identities and the digits they are written in.
NAMESPACE = "6f1d2c3e00004000800000000000a2c1"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    """32 hexadecimal digits of the name-based identity of a key: a digest with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), key.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def compressed(digits: Column) -> Column:
    """32 hexadecimal digits in 22 of base 64: the first byte in two, then three bytes in four."""

    def base64(start: int, length: int, out: int) -> list[Column]:
        value = F.conv(F.substring(digits, start, length), 16, 10).cast("long")
        return [F.substring(F.lit(DIGITS), (F.floor(value / 64**k) % 64).cast("int") + 1, F.lit(1)) for k in range(out - 1, -1, -1)]

    parts = base64(1, 2, 2)
    for start in range(3, 33, 6):
        parts += base64(start, 6, 4)
    return F.concat(*parts)


def global_id(key: Column) -> Column:
    return compressed(uuid5(key))


def content_key(*parts: Column) -> Column:
    """A cache key: the digest of what a result depends on."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
