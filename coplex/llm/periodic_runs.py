"""Runs of repeated words: maximal periodic stretches, found in each text on its own.

A run of period p holds a place of the grid p, 2p, 3p, ... in its first period, whose word recurs p words later; so all pairs
of neighbouring grid places, of which a text of n words has n ln n, are candidates. Those with equal words are extended to
both sides by queries on the text's run-length grammar (recompression.py), which gives the run's exact ends. Texts of one
batch share the array operations; a task holds about BATCH words, or one text if that is longer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import SPACE, WORD, give_back
from .recompression import Grammar

#: Least words of a run.
LEAST = 12
BATCH = 250_000
#: Candidates that are judged at a time.
CANDIDATES = 1_000_000


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period. words: numbers of the words of all texts, one text
    after the other; sizes: words of each text."""
    begins = np.cumsum(sizes) - sizes
    owners = np.repeat(np.arange(len(sizes)), sizes)
    symbols = pd.factorize(owners * (int(words.max(initial=0)) + 1) + words)[0].astype(np.int64)
    grammar, plain = Grammar(symbols, owners), symbols.astype(np.int32)
    halves = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (sizes[text] - 1) // period
    ends, found = np.cumsum(counts), []
    for part in np.split(np.arange(len(text)), np.searchsorted(ends, np.arange(CANDIDATES, ends[-1] if len(ends) else 0, CANDIDATES))):
        if not len(part):
            continue
        n, p = counts[part], np.repeat(period[part], counts[part])
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(begins[text[part]], n) + step * p
        hit = plain[i] == plain[i + p]
        i, p = i[hit], p[hit]
        right = grammar.extensions(i, i + p, 1)
        left = grammar.extensions(i - 1, i + p - 1, -1)
        length = p + left + right
        good = length >= np.maximum(least, 2 * p)
        found.append(np.stack([i[good] - left[good], length[good], p[good]]))
    start, length, p = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    least_period = np.ones(len(start), bool)  # of a stretch's periods the smallest is its period
    least_period[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[least_period], length[least_period], p[least_period]
    order = np.lexsort((p, start))
    start, length, p = start[order], length[order], p[order]
    of = owners[start] if len(start) else start
    return of, start - begins[of], length, p


def _judged(texts: list[list[str]], least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and what stays of the words, for each text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    numbers = pd.factorize(np.array([w for x in texts for w in x], dtype=object))[0].astype(np.int64)
    text, start, length, period = find_runs(numbers, sizes, least)
    runs: list[list[dict]] = [[] for _ in texts]
    drops: dict[int, np.ndarray] = {}
    for t, s, n, p in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": n, "period": p})
        edges = drops.setdefault(t, np.zeros(sizes[t] + 1, np.int64))
        edges[s + p] += 1
        edges[s + n] -= 1
    for t, edges in drops.items():
        texts[t] = [w for w, gone in zip(texts[t], np.cumsum(edges[:-1]).tolist(), strict=True) if not gone]
    return runs, [" ".join(x) for x in texts]


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with runs, all runs of a text's words by start and period, and with a text of the words that are in no run after
    its first period, joined by one space (columns named runs and the text's are replaced, and come last).

    Whole texts are judged, each on its own. A null or empty text has no runs and comes back empty; repeated rows are judged
    each; an empty table gives an empty result. All other columns, whatever their names, come through."""
    rest = [c for c in docs.columns if c not in ("runs", text_col)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    find = re.compile(WORD).findall

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = 0, 0
            held: list[list[str]] = []
            for i, text in enumerate(batch.column(1)):
                held.append(find(text.as_py() or ""))
                n += len(held[-1])
                if n >= BATCH or i + 1 == batch.num_rows:
                    runs, texts = _judged(held, least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc", "runs", "text"])
                    at, n, held = i + 1, 0, []
        give_back()

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest or [text_col])).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([packed.schema["doc"], StructField("runs", ArrayType(StructType([StructField(x, LongType()) for x in ("start", "length", "period")]))), StructField("text", StringType())])
    out = packed.mapInArrow(judge, schema)
    return out.select(*(F.col("doc").getField(c).alias(c) for c in rest), "runs", F.col("text").alias(text_col))


def planted(text: Column, doc_id: Column) -> Column:
    """The text; of every tenth document by crc32 of its decimal id, words from one on repeat with a period, joined by a space."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    one = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, one).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    found = collapse_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n"))), "")
    kept = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return kept.select(
        "doc_id", "n_runs", (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"), F.floor(1000 * F.col("x.length") / -F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
