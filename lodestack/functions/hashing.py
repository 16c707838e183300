"""Deterministic hashes, splits and sampling, as column expressions.

Every function is a pure function of its input string, so results don't
depend on partitioning; null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_mod(digest: Column, digits: int, modulo: int) -> Column:
    """The first hex digits of a digest as a number, modulo.  15 digits at a time, so no 64-bit sign is met."""
    if digits <= 15:
        return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long") % modulo
    head = F.conv(F.substring(digest, 1, digits - 8), 16, 10).cast("long") % modulo
    tail = F.conv(F.substring(digest, digits - 7, 8), 16, 10).cast("long")
    return (head * (16**8 % modulo) + tail) % modulo


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def bucket_sha1(key: Column, modulo: int = 100) -> Column:
    return hex_mod(F.sha1(key), 8, modulo)


def bucket_sha256(key: Column, modulo: int = 100, digits: int = 16) -> Column:
    return hex_mod(sha256(key), digits, modulo)


def split_by_bucket(bucket: Column, train: int, validation: int) -> Column:
    """train, validation or test by a bucket of 0 to 99."""
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").when(bucket.isNotNull(), "test")


def salted_order(key: Column, salt: str) -> Column:
    """A string to order by in place of a seeded shuffle."""
    return sha256(F.concat(F.lit(f"{salt}:"), key))


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(sha256(text), 1, digits)


def side(key: Column) -> Column:
    """A stable boolean: whether the digest is even."""
    return F.conv(F.substring(sha256(key), 64, 1), 16, 10).cast("int") % 2 == 0


def unit_interval(key: Column) -> Column:
    """A stable number in [0, 1): the first 16 hex digits over 16**16."""
    digest = sha256(key)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
    return (high * 16.0**8 + low) / 16.0**16


def repeats(rate: float, key: Column) -> Column:
    """How often a row comes: the whole part of ``rate``, and once more for the keys below its fraction."""
    if rate <= 0:
        return F.lit(0)
    whole = int(rate)
    return F.lit(whole) + F.when(unit_interval(key) < rate - whole, 1).otherwise(0)
