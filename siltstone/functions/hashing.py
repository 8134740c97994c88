"""Stable ids and seeded orders, all from SHA-1, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, length)


def unit_id(member_ids: Column) -> Column:
    """The same for any order of the members."""
    return F.concat(F.lit("unit_"), stable_hash(F.array_join(F.array_sort(member_ids), "::"), 16))


def example_id(unit: Column, claim: Column, question: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("synthetic_"), stable_hash(F.concat_ws("\n", empty(unit), empty(claim), empty(question)), 16))


def seeded_order(seed: int, *keys: Column) -> Column:
    """A shuffle's sort key: it depends on the seed and the keys alone, not on partitions."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]).cast("binary"))


def seeded_index(seed: int, size: Column | int, *keys: Column) -> Column:
    """A number from 0 to size - 1."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.pmod(F.conv(F.substring(seeded_order(seed, *keys), 1, 12), 16, 10).cast("long"), size.cast("long"))
