"""An index's counts kept up to date from a stream of changes: posts that come (op 1) and go (op -1).

Every micro-batch writes what it adds to each table into a folder of its own, named by its number, so a batch that is repeated
replaces itself and batches may come in any order. Counts of items by rating and of item pairs are sums over posts, hence over
batches; a retraction is the same post with the opposite sign. Readers sum up; compacted() writes the sums as one batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coplex.sources import posts as ps

TABLES = {"rates": "rating string, tag string, n long", "pairs": "a string, b string, n long", "sizes": "rating string, n long"}


def deltas(posts: DataFrame, required: Sequence[str], excluded: Sequence[str], prefixes: Sequence[str]) -> dict[str, DataFrame]:
    """What posts (id, rating, general_tags, op) add: rates by rating, pairs (a < b by name) of items with one of the prefixes over
    posts that have all of the required items and none of the excluded, sizes by rating. Sums of zero are no rows."""
    tags = F.array_distinct(F.coalesce("general_tags", F.array().cast("array<string>")))
    each = posts.select("rating", "op", tags.alias("tags"))
    inside = F.lit(True)
    for x in required:
        inside &= F.array_contains("tags", x)
    for x in excluded:
        inside &= ~F.array_contains("tags", x)
    wanted = lambda t: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p))
    # posts alike in their items are summed up before they give pairs
    alike = each.filter(inside).groupBy(F.array_sort(F.filter("tags", wanted)).alias("tags")).agg(F.sum("op").alias("op")).filter("op <> 0")
    first = alike.select("op", F.posexplode("tags").alias("i", "a"), "tags")
    both = first.select("op", "a", F.explode(F.slice("tags", F.col("i") + 2, F.size("tags"))).alias("b"))
    total = F.sum("op").cast("long").alias("n")
    return {
        "rates": each.select("rating", "op", F.explode("tags").alias("tag")).groupBy("rating", "tag").agg(total).filter("n <> 0"),
        "pairs": both.groupBy("a", "b").agg(total).filter("n <> 0"),
        "sizes": each.groupBy("rating").agg(total).filter("n <> 0"),
    }


def refresh(changes: DataFrame, path: str, checkpoint: str, required: Sequence[str] = (), excluded: Sequence[str] = (), prefixes: Sequence[str] = ("",)) -> StreamingQuery:
    """Writes every micro-batch's deltas below path until all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, df in deltas(kept, required, excluded, prefixes).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        kept.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as of all batches: rows whose counts have come to nothing are gone."""
    rows = spark.read.schema(TABLES[name] + ", batch long").parquet(f"{path}/{name}")
    keys = [x.split()[0] for x in TABLES[name].split(", ")][:-1]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """The sums of all batches as batch -1 below another path."""
    for name in TABLES:
        current(spark, path, name).write.mode("overwrite").parquet(f"{target}/{name}/batch=-1")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, n, tid) of all ratings as of all batches."""
    counts = current(spark, path, "rates").groupBy("tag").agg(F.sum("n").alias("n"))
    return ps.ranked(counts, "tid", F.desc("n"), F.col("tag"))
