"""Reproducible pseudo-random order and indexes made of portable hash functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def hash_key(seed: str, *values: Column | str) -> Column:
    """md5 of ``seed|value|...``: sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(v) for v in values]))


def hash_index(seed: str, n: Column | int, *values: Column | str) -> Column:
    """Index in 0..n-1 drawn from the hash of ``seed|value|...``."""
    head = F.conv(F.substring(hash_key(seed, *values), 1, 8), 16, 10).cast("long")
    return head % (F.lit(n) if isinstance(n, int) else n)
