"""Manifests of index files: size and checksum tree of each, what is missing or partial, and what to fetch again.

A file's checksum is a tree of two levels: SHA-256 of each block of BLOCK bytes, and SHA-256 of the block digests in
order. Blocks are hashed by as many tasks as there are, so a file may have any size; a copy of which a part is there is
checked block by block, and only blocks that are absent or differ are fetched again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes hashed in one piece.
BLOCK = 64 << 20
#: Bytes read at a time within a block.
READ = 1 << 20
#: A partial copy of a file has its name and this ending.
PARTIAL = ".part"


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of the files under a path, without reading them; as everywhere here, Spark's reader skips empty ones."""
    return _files(spark, path).select("name", "size")


def manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, size, sha256) per file. Each file is hashed in one piece in its task's memory, so it must be below 2 GB;
    tree() takes files of any size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def ranges(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """files (with a size) as one row per block: block number, start, length. An empty object has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / block))
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    return cut.withColumns({"start": F.col("block") * block, "length": F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)})


def _hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path, start, length in zip(*(batch.column(x).to_pylist() for x in ("path", "start", "length")), strict=True):
            system, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", quote(path, safe=":/")))
            digest = hashlib.sha256()
            with system.open_input_file(place) as file:
                file.seek(start)
                while length > 0 and (data := file.read(min(READ, length))):
                    digest.update(data)
                    length -= len(data)
            digests.append(digest.hexdigest())
        yield batch.select(["name", "size", "block", "start", "length"]).append_column("sha256", pa.array(digests, pa.string()))


def blocks(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """(name, size, block, start, length, sha256) of every block of the files under a path.

    Tasks read ranges of files, READ bytes at a time, so neither a file's size nor a block's bounds memory, and a lost
    task reads its blocks again. The folder must be one that every executor reaches."""
    cut = ranges(_files(spark, path, pattern), block)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.repartition(tasks, "name", "block").select("path", "name", "size", "block", "start", "length")
    return dealt.mapInArrow(_hash_ranges, "name string, size long, block long, start long, length long, sha256 string")


def text_blocks(objects: DataFrame, name: Column, text: Column, block: int = BLOCK) -> DataFrame:
    """Like blocks() for objects that are rows: the UTF-8 bytes of a text, null as empty, cut and hashed without Python."""
    data = objects.select(name.cast("string").alias("name"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data")).withColumn("size", F.octet_length("data").cast("long"))
    cut = ranges(data, block)
    piece = F.substring(F.col("data"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return cut.select("name", "size", "block", "start", "length", F.sha2(piece, 256).alias("sha256"))


def tree(hashed: DataFrame) -> DataFrame:
    """(name, size, n_blocks, root) per file of blocks(): root is the SHA-256 of its blocks' hexadecimal digests, in order."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"])
    return hashed.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(F.array_join(digests, ""), 256).alias("root"))


def status(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(name, size, have, state) per file of a manifest, by a listing, without reading any.

    A file of the right name and size is `complete`; otherwise the bytes of its partial copy count, up to its size, and it
    is `partial`, or `missing` if there is none. A file of another size counts for nothing."""
    sizes = found.groupBy("name").agg(F.max("size").alias("found"), F.collect_set("size").alias("sizes"))
    whole = sizes.select("name", "sizes")
    part = sizes.filter(F.col("name").endswith(PARTIAL)).select(F.expr(f"left(name, length(name) - {len(PARTIAL)})").alias("name"), F.col("found").alias("part"))
    have = F.when(F.array_contains("sizes", F.col("size")), F.col("size")).otherwise(F.least(F.coalesce("part", F.lit(0)), F.col("size"))).cast("long")
    state = F.when(F.array_contains("sizes", F.col("size")), "complete").when(F.col("part").isNotNull(), "partial").otherwise("missing")
    return wanted.select("name", "size").join(whole, "name", "left").join(part, "name", "left").select("name", "size", have.alias("have"), state.alias("state"))


def to_fetch(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(name, start, length) of the blocks of a manifest that a copy, complete or partial, lacks or has other bytes in.

    Both are tables of blocks cut alike. Neighbouring blocks of a file come as one range, which is what a resumed
    transfer asks for."""
    held = got.select(F.regexp_replace("name", "\\" + PARTIAL + "$", "").alias("name"), "block", "length", "sha256").distinct()
    lack = wanted.join(held, ["name", "block", "length", "sha256"], "left_anti").select("name", "block", "start", "length")
    # in a run of neighbours the block number less the rank stays the same
    run = F.col("block") - F.row_number().over(Window.partitionBy("name").orderBy("block"))
    return lack.withColumn("run", run).groupBy("name", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length")).drop("run")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of a manifest in JSON: {"files": [{"name", "size", "sha256"}, ...]}."""
    schema = "files array<struct<name: string, size: long, sha256: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("files"))


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a manifest that a listing lacks, by name and size."""
    return wanted.join(found.select("name", "size"), ["name", "size"], "left_anti")


def need(df: DataFrame, what: str) -> DataFrame:
    """df, or an error that names what is absent."""
    if df.isEmpty():
        raise FileNotFoundError(f"{what} has no rows; build the index first")
    return df
