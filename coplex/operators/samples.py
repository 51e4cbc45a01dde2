"""Reproducible samples. Order is by MD5 of the key and the seed, so a sample depends on neither partitions nor engine."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import any_bit, has_all, has_any, rating_filter

SAMPLE_CAP, POSTING_CAP, ENTITY_CAP = 50_000, 400_000, 100
#: Baskets of an item's stored sketch: a prefix of its order by hash. Answers don't depend on it, only where they come from.
SKETCH = 20_000
#: Hexadecimal digits of the hash that rows are counted by.
DIGITS = 3


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts: 48 bits of it."""
    text = F.concat_ws("#", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def take(df: DataFrame, n: int, seed: int, key: str = "pid") -> DataFrame:
    """At most n rows, without replacement: those of least hash.

    Rows are counted by the first DIGITS of the hash, which gives the range that the n-th falls into: whole ranges below
    it are taken as they are, and only rows of that one range, a 16 ** DIGITS-th of all, are ordered to cut it."""
    hashed = order_key(key, seed)
    head = F.substring(hashed, 1, DIGITS)
    sizes = sorted(tuple(r) for r in df.groupBy(head.alias("head")).count().collect())  # 16 ** DIGITS rows at most
    before, last = 0, None
    for name, size in sizes:
        if before + size > n:
            last = name
            break
        before += size
    if last is None:
        return df
    edge = df.filter(head == last).orderBy(hashed, key).limit(n - before)
    return df.filter(head < last).union(edge) if before else edge


def cap_entities(baskets: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most `cap` baskets per entity in hash order; entity 0 is uncapped, cap 0 is off."""
    if not cap:
        return baskets
    ranked = baskets.filter("entity <> 0").withColumn("_rank", F.row_number().over(Window.partitionBy("entity").orderBy(order_key("pid", seed), "pid")))
    # entity 0 may hold most rows and needs no rank; Spark keeps `cap` rows of an entity per task before it shuffles
    free = baskets.filter("entity = 0")
    return free.unionByName(ranked.filter(F.col("_rank") <= cap).drop("_rank"))


def posting(rows: DataFrame, tid: int | None, full: bool = False, seed: int = 1, cap: int = POSTING_CAP) -> DataFrame:
    """(pid) of the baskets with an item, at most `cap` of them unless full; an error for an item outside the index."""
    if tid is None:
        raise KeyError("this item is not in the index")
    found = rows.filter(F.col("tid") == tid).select("pid").distinct()
    return found if full else take(found, cap, seed)


def sub_sample(
    baskets: DataFrame, anchors: Sequence[int] = (), rating: str = "all", segment_mask: int = 0, costume_mask: int = 0, excluded: Sequence[int] = (), required: Sequence[int] = (),
    layout: Sequence[int] = (), entity_cap: int = ENTITY_CAP, seed: int = 1, cap: int = SAMPLE_CAP, least: int = 0,
) -> DataFrame:
    """Design sample: every anchor, none of the excluded, all of the required without any of the layout items, any of
    each mask's bits; entities are capped before the sample is drawn. Filters come before sampling, so no posting
    needs a recount. Without anchors it is the wide prior sample. Empty baskets are dropped."""
    kept = baskets.filter(has_all(anchors) & ~has_any(excluded) & has_all(required) & ~has_any(layout) & rating_filter(rating) & (F.size("items") > least))
    if segment_mask:
        kept = kept.filter(any_bit(F.col("segment_bits"), segment_mask))
    if costume_mask:
        kept = kept.filter(any_bit(F.col("costume_bits"), costume_mask))
    return take(cap_entities(kept, entity_cap, seed), cap, seed)


def sketches(baskets: DataFrame, k: int = SKETCH, seed: int = 1) -> DataFrame:
    """The first k baskets by hash of each item, as rows (tid, place, hash, basket...) sorted by item: sketches that merge by taking the
    first k of both. An item's baskets are counted by the bits of their hash's first number; only those up to the bits that k of them
    have are ordered and shuffled, some 2 k at most of an item that more baskets have."""
    hashed = baskets.withColumn("hash", order_key("pid", seed)).withColumn("_bits", F.length(F.conv(F.substring("hash", 1, 12), 16, 2)))
    sizes = hashed.select("_bits", F.explode("items").alias("tid")).groupBy("tid", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("tid").orderBy("_bits"))
    reach = sizes.withColumn("_run", run).filter(F.col("_run") >= k).groupBy("tid").agg(F.min("_bits").alias("_reach"))  # a row per item
    each = hashed.withColumn("tid", F.explode("items")).join(F.broadcast(reach), "tid", "left").filter(F.col("_bits") <= F.coalesce("_reach", F.lit(48)))
    place = F.row_number().over(Window.partitionBy("tid").orderBy("hash", "pid"))
    return each.withColumn("place", place).filter(F.col("place") <= k).select("tid", "place", "hash", *baskets.columns)


def from_sketch(sketch: DataFrame, item: int, size: int, condition: Column, entity_cap: int, cap: int, exact: Callable[[], DataFrame], k: int = SKETCH) -> tuple[DataFrame, bool]:
    """The sample of the item's baskets that meet a condition, with capped entities, and whether the sketch gave it. An item's first k baskets
    by hash are a prefix of the order that entities are capped and samples are taken in, so what is left of them is a prefix of the answer:
    if that is `cap` baskets, or if the item has no more than k (size), it is the answer. Otherwise exact() is."""
    left = sketch.filter((F.col("tid") == item) & condition)
    if entity_cap:
        rank = F.row_number().over(Window.partitionBy("entity").orderBy("hash", "pid"))
        left = left.withColumn("rank", rank).filter((F.col("entity") == 0) | (F.col("rank") <= entity_cap)).drop("rank")
    taken = left.orderBy("hash", "pid").limit(cap)
    if size <= k or taken.count() >= cap:
        return taken.drop("tid", "place", "hash"), True
    return exact(), False


def code_sample(baskets: DataFrame, anchors: Sequence[int], code: int, seed: int = 1, cap: int = SAMPLE_CAP) -> DataFrame:
    """Sample of one rating code: posting and rating alone."""
    return take(baskets.filter(has_all(anchors) & (F.col("rating") == code)), cap, seed)


def is_small(n: int, m: float = 300, stop: int = 10) -> bool:
    """Whether a sample of n baskets needs a wide one to smooth with."""
    return n < stop * m


class SampleCache:
    """Samples by their condition, without the seed, kept in the executors' memory; beyond `most`, the oldest is released."""

    def __init__(self, most: int = 24):
        self.most, self.kept = most, {}

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.kept:
            while len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept))).unpersist()
            self.kept[key] = make()
        if not self.kept[key].storageLevel.useMemory:  # new, or released by others
            self.kept[key].cache()
        return self.kept[key]
