"""A seeded hash that any SQL engine can reproduce.

Samples drawn by it are the same after a retry, on another cluster, and in
another engine, which is what makes them checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60


def seeded_hash(*parts: Column) -> Column:
    """60-bit non-negative integer: the first 15 hex digits of an md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_below(bound: Column, *seeds: Column) -> Column:
    """Seeded integer in [0, bound)."""
    return F.pmod(seeded_hash(*seeds), bound).cast("int")


def hash_unit(*seeds: Column) -> Column:
    """Seeded number in [0, 1)."""
    return seeded_hash(*seeds) / float(1 << BITS)
