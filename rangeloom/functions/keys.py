"""Seeded, partition-independent randomness built from md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | Column, ident: Column) -> Column:
    """Shuffle key: sorting by it is a permutation fixed by (seed, ident)."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(s.cast("string"), F.lit(":"), ident.cast("string")))


def uniform(key: Column, draw: int) -> Column:
    """Uniform [0, 1) double number `draw` of the stream named by `key` (52 random bits)."""
    word = F.substring(F.md5(F.concat(key, F.lit(f":{draw}"))), 1, 13)
    return F.conv(word, 16, 10).cast("double") / F.lit(float(1 << 52))
