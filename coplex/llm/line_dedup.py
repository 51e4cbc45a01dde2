"""Line deduplication by site-relative frequency.

Documents are grouped by host; a line's frequency is the number of the host's pages that contain it over the number
of the host's pages. Lines above a ratio are boilerplate and are dropped. Only line keys are shuffled (128 bits of
SHA-256, so that no line goes for another's sake), one per page and distinct line, counted before they leave a task;
texts are filtered in place. A host has at most (mean lines of a page) / ratio boilerplate lines, so that table stays
small beside the documents; whether it is broadcast is left to its measured size. A page meets its host's table by a
hash set once, and its lines only what of it the page has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, staged

#: A line is boilerplate on more than this share of a host's pages.
RATIO = 0.05
#: A line on a single page doesn't recur, whatever its share of a small host.
RECURS = 2


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def _key(line: Column) -> Column:
    return F.substring(F.sha2(line, 256), 1, 32)


def boilerplate(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, least_pages: int = RECURS) -> DataFrame:
    """(host, boilerplate array<string>): keys of each host's boilerplate lines."""
    host, text = F.coalesce(F.col(f"`{host_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pages = docs.select(host.alias("host"), F.split(text, "\n").alias("lines"))
    distinct = F.array_distinct(F.transform(F.filter(F.transform("lines", _trimmed), lambda x: x != ""), _key))
    counted = pages.select("host", F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    totals = docs.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = counted.join(totals, "host").filter(F.col("n_pages") > ratio * F.col("host_pages"))
    return frequent.groupBy("host").agg(F.collect_set("line").alias("boilerplate"))


def drop_boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = RECURS) -> DataFrame:
    """docs with boilerplate lines gone from text_col, plus n_lines and n_dropped (columns of those names are replaced).

    Lines are compared without the white space around them, blank lines always stay. A null text counts as one
    blank line and comes back empty; null hosts count as ''. A line repeated within a page counts once for it, and
    every repetition is dropped. A line on fewer than least_pages pages stays: by default one that a single page has,
    as on a host of a few pages any line is above the ratio. Repeated rows are pages of their own. An empty table gives an empty result."""
    hosts = staged(boilerplate(docs, host_col, text_col, ratio, least_pages), "boilerplate")
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    keyed = docs.select(packed(docs), F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("host"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n").alias("lines"))
    own = F.array_intersect(F.transform("lines", lambda x: _key(_trimmed(x))), "boilerplate")  # a blank line's key is never boilerplate
    found = keyed.join(hosts, "host", "left").withColumn("own", own)
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("own"), _key(_trimmed(x))))
    out = found.withColumn("kept", F.when(F.coalesce(F.size("own"), F.lit(0)) > 0, kept).otherwise(F.col("lines")))
    return out.select(
        *(F.col("doc").getField(c).alias(c) for c in rest),
        F.array_join("kept", "\n").alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
