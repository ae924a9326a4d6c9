"""Reproducible pseudo-random keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_PREFIX = 15  # 60 bits


def order_key(key: Column | str, seed: int | str = 42) -> Column:
    """MD5 hex of ``seed:key``. Sorting by it is a seeded shuffle any engine can repeat."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def hash_int(key: Column | str, seed: int | str = 42) -> Column:
    """Non-negative bigint drawn from the first 60 bits of :func:`order_key`."""
    return F.conv(F.substring(order_key(key, seed), 1, HEX_PREFIX), 16, 10).cast("bigint")


def pick(options: Column, key: Column | str, seed: int | str) -> Column:
    """One element of an array column, chosen by hash."""
    return F.element_at(options, (hash_int(key, seed) % F.size(options) + 1).cast("int"))
