"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its texts into a sorted run of (digest, best identifier, size). The runs then meet in a few
binomial rounds: a run sits at a slot, and in round j the j-th digit of the slot is exchanged for the j-th digit of
the digest, so a slot takes from `fan` others and merges what arrives. Runs travel as chunks of CHUNK entries. A slot
gets its chunks in the order of their first entries and merges them on a heap, which a chunk joins only when the merge
reaches its first entry: one chunk of each run is open at a time, and no entry is sorted again. Equal digests fold into
one entry at every level, which keeps the best identifier among rows whose full SHA-256 and byte length agree. After
the last round a slot holds all of its range of digests, each once: no key is ever met by more rows than there are
runs, however many copies it has. What stays comes back to the rows by way of the partitions that hold a digest, so
that no join meets all copies of a text either.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, packed, shuffle_partitions, staged

#: Entries of a run that travel together, some 16 KB.
CHUNK = 256
ENTRY = np.dtype([("digest", "V32"), ("n_bytes", "<i8"), ("keep_id", "<i8"), ("keep_row", "<i8"), ("group_size", "<i8")])
Entry = tuple[bytes, int, int, int, int]
RUN = "slot int, first binary, entries binary"
BEST = "digest binary, n_bytes long, keep_id long, keep_row long, group_size long"


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null counts as empty."""
    return (text or "").encode().lower()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, texts = batch.columns
        data = [normalised(x.as_py()) for x in texts]
        yield pa.record_batch(
            {
                "doc_id": ids,
                "row": rows,
                "digest": pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                "n_bytes": pa.array(map(len, data), pa.int64()),
            }
        )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest, n_bytes, part) per row of docs (doc_id, row, text), written once; part is the task that wrote it."""
    made = docs.select("doc_id", "row", "text").mapInArrow(_digest, "doc_id long, row long, digest binary, n_bytes long")
    return staged(made.withColumn("part", F.spark_partition_id()), "digests")


def _fold(entries: Iterable[Entry], largest: bool) -> Iterator[Entry]:
    """One entry for neighbours of one digest and length: the best identifier, of equal ones the first row, the sum of sizes."""
    now = None
    for entry in entries:
        if now is None or entry[0] != now[0] or entry[1] != now[1]:
            if now is not None:
                yield now
            now = entry
            continue
        _, _, i, row, n = entry
        better = i > now[2] if largest else i < now[2]
        keep = (i, row) if better or (i == now[2] and row < now[3]) else now[2:4]
        now = (*now[:2], *keep, now[4] + n)
    if now is not None:
        yield now


def _merge(chunks: Iterable[tuple[bytes, bytes]]) -> Iterator[Entry]:
    """Multiway merge of sorted chunks that come in the order of their first digests; holds those that overlap."""
    heap: list[tuple[Entry, int, Iterator[Entry]]] = []
    for order, (first, data) in enumerate(chunks):
        while heap and heap[0][0][0] < first:
            yield _advance(heap)
        own = iter(np.frombuffer(data, ENTRY).tolist())
        heapq.heappush(heap, (next(own), order, own))
    while heap:
        yield _advance(heap)


def _advance(heap: list) -> Entry:
    entry, order, own = heap[0]
    following = next(own, None)
    if following is None:
        heapq.heappop(heap)
    else:
        heapq.heapreplace(heap, (following, order, own))
    return entry


def _dealt(entries: Iterable[Entry], slot: int, level: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a run at a slot, addressed to the slots that differ in their digit of that level."""
    open_chunks: dict[int, list[Entry]] = {}
    low, mask = bits * level, (1 << bits) - 1

    def made(target: int, held: list[Entry]) -> pa.RecordBatch:
        data = np.array(held, ENTRY).tobytes()
        return pa.record_batch({"slot": pa.array([target], pa.int32()), "first": pa.array([held[0][0]], pa.binary()), "entries": pa.array([data], pa.binary())})

    for entry in entries:
        digit = int.from_bytes(entry[0][:4], "big") >> low & mask
        target = slot & ~(mask << low) | digit << low
        held = open_chunks.setdefault(target, [])
        held.append(entry)
        if len(held) == CHUNK:
            yield made(target, open_chunks.pop(target))
    for target, held in open_chunks.items():
        yield made(target, held)


def _first_runs(largest: bool, bits: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part come sorted by digest; all of a task's parts make one run each."""
        rows = chain.from_iterable(zip(*(x.to_pylist() for x in batch.columns), strict=True) for batch in batches)
        for part, own in _by_key(rows):
            yield from _dealt(_fold(own, largest), part % slots, 0, bits)

    return run


def _by_key(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows grouped by their first value, which is left out of them."""
    for key, own in groupby(rows, lambda x: x[0]):
        yield key, (x[1:] for x in own)


def _merged(largest: bool, bits: int, level: int, rounds: int):
    """Merges what has come to a slot; deals it for the next round, or gives it out after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(x.to_pylist() for x in batch.columns), strict=True) for batch in batches)
        for slot, chunks in _by_key(rows):
            entries = _fold(_merge(chunks), largest)
            yield from _dealt(entries, slot, level + 1, bits) if level + 1 < rounds else _given(entries)

    return run


def _given(entries: Iterator[Entry]) -> Iterator[pa.RecordBatch]:
    held: list[Entry] = []
    for entry in entries:
        held.append(entry)
        if len(held) == 32 * CHUNK:
            yield _table(held)
            held = []
    if held:
        yield _table(held)


def _table(held: list[Entry]) -> pa.RecordBatch:
    digest, *rest = zip(*held, strict=True)
    return pa.record_batch([pa.array(digest, pa.binary()), *(pa.array(x, pa.int64()) for x in rest)], names=list(ENTRY.names))


def merged_runs(digest_rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """One entry per distinct text: (digest, n_bytes, keep_id, keep_row, group_size)."""
    largest = keep == "largest"
    wanted = max(2, shuffle_partitions(digest_rows.sparkSession))
    rounds = 2 if wanted <= 1024 else 3
    bits = -(-(wanted - 1).bit_length() // rounds)
    slots = 1 << (bits * rounds)
    rows = digest_rows.select("part", "digest", "n_bytes", F.coalesce("doc_id", F.lit(NO_ID)).alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    runs = rows.sortWithinPartitions("part", "digest", "n_bytes").mapInArrow(_first_runs(largest, bits, slots), RUN)
    for level in range(rounds):
        came = runs.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "first")
        runs = came.mapInArrow(_merged(largest, bits, level, rounds), RUN if level + 1 < rounds else BEST)
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty texts form one group.
    Of equal texts the row with the smallest (or largest) identifier stays; a null identifier is lower than any
    other. Rows that share text and identifier are copies too: exactly one of them stays. An empty table gives an
    empty result; other columns are never read, so their names don't matter."""
    rows = digests(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")))
    held = rows.select("part", "digest", "n_bytes").distinct()
    best = staged(held.join(merged_runs(rows, keep), ["digest", "n_bytes"]), "kept")
    return rows.join(best, ["part", "digest", "n_bytes"]).select(
        "doc_id",
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without its copies, all columns as they are, whatever their names.

    Texts are equal as for exact_dedup: null and empty ones form one group, of which one row stays. The row of the
    smallest (or largest) identifier stays, a null identifier being lower than any other; of rows alike in that, repeated
    rows among them, the first in the table's order stays. An empty table stays empty."""
    stored = staged(docs.select(packed(docs), F.monotonically_increasing_id().alias("row")), "documents")
    keyed = stored.select(F.col("doc").getField(id_col).cast("long").alias("doc_id"), "row", F.col("doc").getField(text_col).alias("text"))
    best = merged_runs(digests(keyed), keep).select(F.col("keep_row").alias("row"))
    # what stays grows with the table, so it is joined in the same way at every size
    return stored.join(staged(best, "kept").hint("merge"), "row", "left_semi").select("doc.*")
