"""Predicates over baskets (pid, items, ...) and the bit masks of segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(item: int, items: str = "items") -> Column:
    return F.array_contains(items, item)


def has_all(wanted: Sequence[int], items: str = "items") -> Column:
    """Exact match: every wanted item; true for none."""
    out = F.lit(True)
    for x in wanted:
        out &= has(x, items)
    return out


def has_any(pool: Sequence[int], items: str = "items") -> Column:
    """Any of a pool; false for an empty one."""
    return F.arrays_overlap(F.col(items), F.array(*map(F.lit, pool)).cast("array<smallint>")) if pool else F.lit(False)


def packed_bits(conditions: Sequence[Column]) -> Column:
    """Bit i is set where condition i holds; null counts as false."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions)), F.lit(0)).cast("int")


def mask_of(keys: Sequence[str], order: Sequence[str]) -> int:
    """Mask of the named bits; unknown names, and the name all, are dropped."""
    return sum(1 << order.index(k) for k in dict.fromkeys(keys) if k in order and k != "all")


def any_bit(bits: Column, mask: int) -> Column:
    """An empty mask passes everything."""
    return bits.bitwiseAND(F.lit(mask)) != 0 if mask else F.lit(True)


def rating_filter(rating: str, code: str = "rating") -> Column:
    """gs: codes up to 1. Anything else passes all, as design samples ignore other ratings."""
    return F.col(code) <= 1 if rating == "gs" else F.lit(True)


def carrying_all(rows: DataFrame, items: Sequence[int]) -> DataFrame:
    """(pid) of baskets with every one of the items, from the item-major table."""
    wanted = sorted(set(items))
    hits = rows.filter(F.col("tid").isin(wanted)).select("pid", "tid").distinct()
    return hits.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("pid")


def without_any(baskets: DataFrame, rows: DataFrame, items: Sequence[int]) -> DataFrame:
    return baskets.join(rows.filter(F.col("tid").isin(list(items))).select("pid"), "pid", "left_anti")
