"""Suffix-array deduplication: removes every byte covered by a string of LENGTH bytes that also starts elsewhere.

Spark narrows the corpus down to what suffix sorting has to decide. Every start of a LENGTH-byte string belongs to
one anchor: the K-byte string of least hash inside it, the leftmost of equals. Equal strings have equal anchors at
equal places, so a repeated string is found among the occurrences of one anchor, and anchors that occur once are
dropped. An occurrence's context is all that the strings of its anchor cover. Contexts that occur twice or more are
repeated whole. Different contexts of one anchor are cut to what some other of them shares, left and right of the
anchor, and suffix-sorted together (gsaca.py); neighbours in that order tell which strings repeat. A group of more than
MOST_CONTEXTS contexts is split first: a string reaches at least half of what it has beside the anchor to the left, or
half to the right, so contexts are grouped anew by that half on either side, until groups are small enough to sort or share
a whole string. Equal texts are one text from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, staged, unstage
from .gsaca import repeated_starts

LENGTH, K = 200, 80
#: Contexts of a group that go to one task, of some 300 bytes each; larger groups are split before.
MOST_CONTEXTS = 50_000
#: Symbols that are suffix-sorted at a time.
SYMBOLS = 500_000
#: Starts of a text that are worked on at a time.
CHUNK = 1 << 18

BASE = 0x9E3779B97F4A7C15
_table = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int) -> np.ndarray:
    if base not in _powers:
        out = np.ones(1, np.uint64)
        while len(out) < CHUNK + 2 * LENGTH:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
        _powers[base] = out
    return _powers[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any slices of a byte string of at most CHUNK + 2 * LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table[data] * _power(BASE)[: len(data)], out=self.sums[1:])
        self.inverse = _power(pow(BASE, -1, 2**64))

    def all(self, width: int) -> np.ndarray:
        """Hashes of all slices of that width; slices with equal bytes have equal ones."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.inverse[: len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        return out

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, context hash, anchor, first start, end of the last string) of each run of starts with one anchor."""
    low = np.uint64((1 << 22) - 1)
    for offset in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - offset), offset)
        rolling = Rolling(data)
        hashed = rolling.all(k)
        placed = hashed & ~low
        placed |= np.arange(len(hashed), dtype=np.uint64)
        chosen = (_least(placed, length - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        end = np.append(first[1:], len(chosen)) - 1 + length
        anchor = chosen[first]
        context = _mix(rolling(first, end) + (anchor - first).astype(np.uint64) * np.uint64(BASE))
        yield hashed[anchor].view(np.int64), context.view(np.int64), anchor + offset, first + offset, end + offset


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [(x.as_py() or "").encode() for x in batch.column(1)]
        yield pa.record_batch({"doc_id": batch.column(0), "key": pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), "n_bytes": pa.array(map(len, data), pa.int64())})


def _keyed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"key": pa.array([hashlib.sha256((x.as_py() or "").encode()).digest() for x in batch.column(0)], pa.binary()), "text": batch.column(0)})


ANCHORS = "h long, context long, id long, at int, first int, stop int"


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for h, c, at, first, stop in anchors(text.as_py().encode(), length, k):
                    held.append((h, c, np.full(len(h), i), at, first, stop))
                    rows += len(h)
                if rows > 50_000:
                    yield made(held)
                    held, rows = [], 0
        if held:
            yield made(held)
        give_back()

    def made(held: list[tuple]) -> pa.RecordBatch:
        h, c, i, at, first, stop = map(np.concatenate, zip(*held, strict=True))
        return pa.record_batch({"h": h, "context": c, "id": i, "at": at.astype(np.int32), "first": first.astype(np.int32), "stop": stop.astype(np.int32)})

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts asked for, cut at their anchors."""
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = text.as_py().encode()
            rows += [(x["h"], x["context"], data[x["first"] : x["at"]], data[x["at"] : x["stop"]]) for x in asked]
        h, c, left, right = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch({"h": pa.array(h, pa.int64()), "context": pa.array(c, pa.int64()), "before": pa.array(left, pa.binary()), "after": pa.array(right, pa.binary())})


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _shared(strings: list[bytes]) -> list[int]:
    """Length of the longest prefix that each string has in common with any other."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(strings[i], strings[j])
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def repeated_spans(before: list[bytes], after: list[bytes], length: int = LENGTH, k: int = K, symbols: int = SYMBOLS) -> list[list[tuple[int, int]]]:
    """Spans (relative to the anchor) of each context whose strings of `length` bytes repeat in another context.

    after begins with the k bytes of the anchor. What would be more than `symbols` to sort at a time is split by halves
    as larger groups are."""
    spans: list[list[tuple[int, int]]] = [[] for _ in before]

    def find(own: Sequence[int], l: int, r: int) -> None:
        """Contexts that have l bytes before the anchor and r behind it in common."""
        if l + r + k == length:  # a whole string
            for i in own:
                spans[i].append((-l, k + r))
            return
        lefts, rights = _shared([before[i][::-1] for i in own]), _shared([after[i] for i in own])
        segments: dict[bytes, list[tuple[int, int]]] = {}
        for i, a, b in zip(own, lefts, rights, strict=True):
            if a + b >= length:
                segments.setdefault(before[i][len(before[i]) - a :] + after[i][:b], []).append((i, a))
        parts = list(segments)
        if sum(map(len, parts)) > symbols:
            half = -(-(length - k - l - r) // 2)
            for x, y in ((l + half, r), (l, r + half)):
                groups: dict[bytes, list[int]] = {}
                for i in own:
                    if len(before[i]) >= x and len(after[i]) >= k + y:
                        groups.setdefault(before[i][len(before[i]) - x :] + after[i][: k + y], []).append(i)
                for group in groups.values():
                    if len(group) > 1:
                        find(group, x, y)
            return
        starts = repeated_starts(parts, length) if len(parts) > 1 else [[] for _ in parts]
        for part, found in zip(parts, starts, strict=True):
            if len(segments[part]) > 1:
                found = range(len(part) - length + 1)  # several contexts share all of it
            runs: list[list[int]] = []
            for s in found:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + length
                else:
                    runs.append([s, s + length])
            for i, a in segments[part]:
                spans[i] += [(x - a, y - a) for x, y in runs]

    find(range(len(before)), 0, 0)
    return spans


SPANS = "h long, context long, begin int, end int"


def _sort_contexts(length: int, k: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, h, context, before, after) come sorted by part, of which each has MOST_CONTEXTS at most."""
        group, held, out = None, [], []

        def finish() -> None:
            spans = repeated_spans([x[2] for x in held], [x[3] for x in held], length, k, symbols)
            out.extend((x[0], x[1], a, b) for x, own in zip(held, spans, strict=True) for a, b in own)
            held.clear()

        def made() -> pa.RecordBatch:
            h, c, a, b = zip(*out) if out else ((), (), (), ())
            out.clear()
            return pa.record_batch({"h": pa.array(h, pa.int64()), "context": pa.array(c, pa.int64()), "begin": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32())})

        for batch in batches:
            for part, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != group:
                    if held:
                        finish()
                    group = part
                held.append(row)
            if out:
                yield made()
        if held:
            finish()
        yield made()
        give_back()

    return run


def _spans(cut: DataFrame, length: int, k: int) -> DataFrame:
    """SPANS of the contexts (h, context, before, after) whose strings repeat in another context of their anchor."""
    found, left = [], length - k
    # of a group's contexts, `l` bytes before the anchor and `r` behind it are equal
    groups = cut.select(F.col("h").cast("string").alias("part"), F.lit(0).alias("l"), F.lit(0).alias("r"), "h", "context", "before", "after")
    while True:
        sizes = staged(groups.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        small, large = sizes.filter(F.col("n") <= MOST_CONTEXTS).select("part"), sizes.filter(F.col("n") > MOST_CONTEXTS).select("part")
        together = groups.join(small, "part", "left_semi").select("part", "h", "context", "before", "after").repartition("part").sortWithinPartitions("part")
        found.append(staged(together.mapInArrow(_sort_contexts(length, k, SYMBOLS), SPANS), "spans"))
        if large.isEmpty():
            break
        rest = groups.join(large, "part", "left_semi")
        if left == 0:  # they share a whole string
            found.append(staged(rest.select("h", "context", (-F.col("l")).alias("begin"), (k + F.col("r")).alias("end")), "spans"))
            break
        half = -(-left // 2)
        sides = []
        for l, r in ((F.col("l") + half, F.col("r")), (F.col("l"), F.col("r") + half)):
            reach = rest.withColumns({"l": l, "r": r}).filter((F.octet_length("before") >= F.col("l")) & (F.octet_length("after") >= k + F.col("r")))
            near = F.concat(F.substring(F.col("before"), F.octet_length("before") - F.col("l") + 1, F.col("l")), F.substring(F.col("after"), F.lit(1), k + F.col("r")))
            sides.append(reach.withColumn("part", F.concat_ws(" ", F.col("l").cast("string"), F.sha2(near, 256))))
        groups, left = staged(sides[0].unionByName(sides[1]), "groups"), left - half
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            data, kept, at, runs, removed = text.encode(), [], 0, 0, 0
            for begin, end in sorted((x["begin"], x["end"]) for x in spans):
                if begin > at or not runs:
                    kept.append(data[at:begin])
                    runs += 1
                    removed += end - begin
                    at = end
                elif end > at:
                    removed += end - at
                    at = end
            kept.append(data[at:])
            rows.append((key, removed, runs, b"".join(kept)))
        key, removed, runs, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch({"key": pa.array(key, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})


def removals(docs: DataFrame, text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(key, n_removed, n_spans, kept) of each distinct text that loses some bytes but is not a copy; key is the
    SHA-256 of the text. Of texts with copies, nothing of LENGTH bytes or more stays, so they need no row."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    single = text.filter(F.octet_length("text") >= length).mapInArrow(_keyed_texts, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = staged(single.withColumn("id", F.monotonically_increasing_id()), "texts")
    found = staged(texts.select("id", "text").mapInArrow(_anchors(length, k), ANCHORS), "anchors")
    # written, so that the joins read both sides by exchanges of their own, whose hot anchors Spark can split
    often = staged(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "often")
    several = staged(found.join(often, "h", "left_semi"), "several")
    unstage(found)
    contexts = several.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "first", "stop")).alias("one"))
    contexts = staged(contexts, "contexts")
    mixed = staged(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n_contexts")).filter("n_contexts > 1").select("h"), "mixed")
    asked = contexts.join(mixed, "h", "left_semi").select("h", "context", "one.*")
    by_text = asked.groupBy("id").agg(F.collect_list(F.struct("h", "context", "at", "first", "stop")).alias("asked"))
    cut = staged(texts.join(by_text, "id").select("text", "asked").mapInArrow(_slices, "h long, context long, before binary, after binary"), "slices")
    spans = _spans(cut, length, k)
    whole = several.join(contexts.filter("n > 1").select("h", "context"), ["h", "context"], "left_semi").select("id", F.col("first").alias("begin"), F.col("stop").alias("end"))
    # a context that occurs once is its one occurrence; of others the whole span is there already
    part = contexts.filter("n = 1").select("h", "context", "one.id", "one.at").join(spans, ["h", "context"]).select("id", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"))
    of_text = staged(whole.union(part), "removed").groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return texts.filter("copies = 1").join(of_text, "id").select("key", "text", "spans").mapInArrow(_removals, "key binary, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes of the UTF-8 text that covers it also starts anywhere else, in the
    same row included. Null counts as empty; shorter texts lose nothing; repeated rows lose all, being copies. An
    empty table gives an empty result; other columns are not read."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = staged(slim.mapInArrow(_keys, "doc_id long, key binary, n_bytes long"), "keys")
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    partly = removals(docs, text_col, length).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    # written, so that the join can split a text with many copies
    known = staged(copies.join(staged(partly, "removals"), "key", "left"), "known")
    return keyed.join(known, "key").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs whose texts have lost what suffix_dedup removes; all other columns as they are, whatever their names.

    Every row stays: those whose text goes whole have an empty one, a null text stays null. What a removal leaves of a
    character that it cut is dropped too, so that texts stay UTF-8. Equal texts of `length` bytes or more, repeated rows
    among them, are copies of each other and go whole. An empty table stays empty."""
    columns = docs.columns
    text = F.col(f"`{text_col}`")
    keyed = docs.select(packed(docs), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("key"))
    copied = docs.filter(F.octet_length(text) >= length).groupBy(F.unhex(F.sha2(text, 256)).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit("").alias("kept"))
    left = removals(docs.select(text.alias("text")), "text", length).select("key", "kept").mapInArrow(_decoded, "key binary, kept string")
    changed = keyed.join(staged(left.union(copied), "changed").hint("merge"), "key", "left")
    return changed.select(*(F.coalesce("kept", F.col("doc").getField(c)).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"key": batch.column(0), "kept": pa.array([x.as_py().decode(errors="ignore") for x in batch.column(1)], pa.string())})
