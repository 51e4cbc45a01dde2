"""Stored tables: the shared folder, staged results, ranks without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="coplex-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df written as Parquet and read again; the committer makes the write atomic, and a retry replaces it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df stored in a folder of its own below the shared one."""
    return stored(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def delete(df: DataFrame) -> None:
    """Deletes the folder of a staged DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its place (1 and on) in a total order, by ranges: every range numbers its own rows, and the ranges' sizes,
    one number each, place them. No task sorts more than its range."""
    run = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(run.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    before, starts = 0, []
    for i in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(i, 0)
    start = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("_range"))
    return rows.withColumn(name, (start + F.col("_place") + 1).cast("int")).drop("_range", "_place")
