"""The training-data pipeline: quality filter, exact and near deduplication, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result as
Parquet to the shared folder and reads it again as the next stage's docs. A stage begins by deleting what the
one before it staged, so the result of each stage must be written before the next one is called. All but the last return the columns of
documents. Packing, whose token ids SQL has no function for, ends the pipeline, so there is no oracle SQL; tests hold
the stages against brute force."""

from __future__ import annotations

import threading
import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coplex.llm.common import delete, noting, shared_dir, table, written
from coplex.llm.exact_dedup import keep_one
from coplex.llm.ngram_join import keep_one_of_class
from coplex.llm.packing import pack
from coplex.llm.quality_mil import fit_quality, keep_quality
from coplex.llm.suffix_dedup import drop_repeats


#: Folders that the stage run last in a thread keeps for its result, so that pipelines in several threads keep apart.
_last = threading.local()
#: Whole texts go to Python by so many, so that batches stay small beside an executor's memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def _stage(make):
    """make as a stage: it begins by deleting what the stage before kept on disk for its result, which has been written.
    It leaves the session with BATCH, which its result needs until written; run() puts the setting back."""

    @wraps(make)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in getattr(_last, "folders", ()):
            delete(spark, path)
        _last.folders = []
        spark.conf.set(*BATCH)
        with noting(_last.folders):
            return make(spark, docs, sf_dir)

    return run


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go.

    It learns from the labelled rows of docs and of the labels table that are not held out, and scores every whole text,
    null as empty. Repeated rows are judged alike; an empty table stays empty; columns are never renamed or read for
    scores. Without a label of either kind every document gets the smoothed share of label 1, so all of them stay or go."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row of the largest identifier stays.

    Null and empty texts are equal, a null identifier is lower than any other, and of rows alike in that the first in the
    table's order stays. An empty table stays empty; other columns, whatever their names, come through."""
    return keep_one(docs, keep="largest")


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near-duplicates (five words, similarity 0.8), the row of the smallest identifier stays.

    Texts without a word are in no class and stay; a null identifier is higher than any other, and of rows alike in that
    the first in the table's order stays. An empty table stays empty; other columns, whatever their names, come through."""
    return keep_one_of_class(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte covered by a 200-byte string that also starts elsewhere; n_chars follows.

    Every row stays, with an empty text if all of it goes, as the texts of repeated rows do; a null text stays null, with
    n_chars 0. An empty table stays empty; other columns, whatever their names, come through."""
    kept = drop_repeats(docs)
    count = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return kept.select(*(count.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in kept.columns))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text gives the end token alone; repeated rows are packed each; an empty table gives no pieces; other
    columns are not read."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=200_000)  # other stages' workers need room too


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", spark.conf.get(BATCH[0])
    _last.folders = []
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}-{name.replace(' ', '-')}")
    finally:
        spark.conf.set(BATCH[0], before)
        for path in _last.folders:
            delete(spark, path)
        _last.folders = []
    return docs
