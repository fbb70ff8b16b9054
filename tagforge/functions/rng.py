"""Chance from hashes: the same in every run, on every partitioning, and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, row: Column, slot: Column | str) -> Column:
    slot = F.lit(slot) if isinstance(slot, str) else slot
    return F.md5(F.concat(F.lit(f"{seed}|"), row.cast("string"), F.lit("|"), slot))


def uniform(seed: int, row: Column, slot: str) -> Column:
    """A number in [0, 1) of 32 bits."""
    return F.conv(F.substring(digest(seed, row, slot), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def randint(seed: int, row: Column, slot: str, low: Column | int, high: Column | int) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(uniform(seed, row, slot) * (high - low + 1))).cast("int")


def shuffled(seed: int, row: Column, slot: str, items: Column) -> Column:
    """An array in the order of its items' hashes."""
    keyed = F.transform(items, lambda x: F.struct(digest(seed, row, F.concat(F.lit(slot + "|"), x)).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])
