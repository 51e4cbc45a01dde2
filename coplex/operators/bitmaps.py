"""Posting bitmaps: which of 64 neighbouring baskets have an item, as one number.

Conditions on items become one aggregation over the words of the items that they name: a bitwise OR for each group of which
any will do, an AND of the groups, an AND NOT of what is excluded. Ratings, segments and costumes are items too, below zero,
so that a whole sample's condition is answered without reading a basket."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of what are no tags: these less the code of a rating or the place of a bit.
RATING, SEGMENT, COSTUME = -1, -10, -50


def words(rows: DataFrame) -> DataFrame:
    """(tid, word, bits) of rows (pid, tid): bit i of a word is basket 64 * word + i. Repeated rows count once."""
    bit = F.expr("shiftleft(1L, int(pid & 63))")
    return rows.groupBy("tid", F.shiftright("pid", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def rated_words(rows: DataFrame, codes: int) -> DataFrame:
    """words() of rows (pid, tid, rating), with the bits of each rating code besides: (tid, word, bits, r0, r1...)."""
    bit = F.expr("shiftleft(1L, int(pid & 63))")
    each = [F.coalesce(F.bit_or(F.when(F.col("rating") == i, bit)), F.lit(0).cast("long")).alias(f"r{i}") for i in range(codes)]
    return rows.groupBy("tid", F.shiftright("pid", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), *each)


def item_major(table: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(pid, tid, rating) of rated words, in their order; letters: the ratings by code."""
    rating = "CASE " + " ".join(f"WHEN getbit(r{i}, i) = 1 THEN '{x}'" for i, x in enumerate(letters)) + " END"
    found = table.select("tid", F.explode(F.expr(f"transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> struct(word * 64 + i AS pid, {rating} AS rating))")).alias("x"))
    return found.select("x.pid", "tid", "x.rating")


def marks(baskets: DataFrame) -> DataFrame:
    """(pid, tid) of baskets' ratings, segments and costumes."""
    of = lambda bits, first: f"transform(filter(sequence(0, 31), i -> getbit({bits}, i) = 1), i -> {first} - i)"
    every = F.expr(f"concat(array({RATING} - rating), {of('segment_bits', SEGMENT)}, {of('costume_bits', COSTUME)})")
    return baskets.select("pid", F.explode(every.cast("array<smallint>")).alias("tid"))


def bits_of(mask: int, first: int) -> list[int]:
    return [first - i for i in range(mask.bit_length()) if mask >> i & 1]


def among(table: DataFrame, groups: Sequence[Collection[int]], excluded: Collection[int] = ()) -> DataFrame:
    """(word, bits) of the baskets that have any item of each group and none of the excluded; only words with a basket. Without a
    group there is nothing to choose from."""
    if not groups:
        raise ValueError("a condition needs a group of items")
    named = sorted({x for g in groups for x in g} | set(excluded))
    has = lambda g: F.coalesce(F.bit_or(F.when(F.col("tid").isin(list(g)), F.col("bits"))), F.lit(0).cast("long")) if g else F.lit(0).cast("long")
    bits: Column = has(groups[0])
    for g in groups[1:]:
        bits = bits.bitwiseAND(has(g))
    bits = bits.bitwiseAND(F.bitwise_not(has(excluded))) if excluded else bits
    return table.filter(F.col("tid").isin(named)).groupBy("word").agg(bits.alias("bits")).filter("bits <> 0")


def pids(found: DataFrame) -> DataFrame:
    """(pid) of the baskets of a bitmap."""
    return found.select(F.explode(F.expr("transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> word * 64 + i)")).alias("pid"))


def size(found: DataFrame) -> DataFrame:
    """One row: n, the baskets of a bitmap."""
    return found.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))
