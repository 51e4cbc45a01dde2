"""Substring search in the dictionary by the short pieces of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the longest pieces; folders that pieces are dealt into.
LONGEST, BUCKETS = 3, 16


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def grams(tags: DataFrame) -> DataFrame:
    """(gram, tid, tag, n, bucket): every piece of one to LONGEST characters of each name, once, sorted by bucket and piece. To be stored
    by bucket."""
    cut = F.expr(f"flatten(transform(sequence(1, {LONGEST}), n -> transform(filter(sequence(1, length(tag)), i -> i + n - 1 <= length(tag)), i -> substring(tag, i, n))))")
    each = tags.select(F.explode(F.array_distinct(cut)).alias("gram"), "tid", "tag", "n")
    return each.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram", "tid")


def containing(table: DataFrame, needle: str) -> DataFrame:
    """(tag, tid, n) of the names that contain the needle, every name for an empty one. Only the buckets of the needle's pieces are read;
    names that have all of them are candidates, which are verified."""
    if not needle:
        return table.select("tag", "tid", "n").distinct()
    size = min(LONGEST, len(needle))
    pieces = sorted({needle[i : i + size] for i in range(len(needle) - size + 1)})
    where = table.sparkSession.createDataFrame([(x,) for x in pieces], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct()
    buckets = [r["b"] for r in where.collect()]  # BUCKETS at most
    hits = table.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(pieces)).groupBy("tid", "tag", "n").agg(F.count(F.lit(1)).alias("pieces"))
    return hits.filter((F.col("pieces") == len(pieces)) & F.contains("tag", F.lit(needle))).select("tag", "tid", "n")
