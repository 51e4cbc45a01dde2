"""Keeps item counts up to date from a stream of incidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(rows: DataFrame) -> DataFrame:
    """(tag, n) over a stream of distinct (pid, tag) rows; Spark keeps one number per tag as state."""
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def refresh(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts to its own folder, so that a repeated batch replaces itself; a reader sums
    them by tag."""

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
