"""What the training-data operators share: tables, the shared folder, ASCII lower-casing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null identifier where identifiers are compared: lower than any other.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


#: Where staged() notes its folders, if anybody asked for it; every thread has its own.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextlib.contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Adds the folders that staged() writes meanwhile to the list."""
    token = _noted.set(folders)
    try:
        yield
    finally:
        _noted.reset(token)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    Each call takes a new folder, so a retried job never meets an older one's files. Folders stay, as results that are
    still to be computed read them, until whoever noted them or the owner of spark.checkpoint.dir clears them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unstage(df: DataFrame) -> None:
    """Deletes the folder of a staged DataFrame that nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if re.search("-[0-9a-f]{32}$", path):
            delete(df.sparkSession, path)


def give_back() -> None:
    """Returns what a Python worker has freed to the system, as it lives on and other stages' workers need room too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one, so that no name of theirs can clash with one that an operator uses."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without user, port, query or fragment; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
