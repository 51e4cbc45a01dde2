"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of r tokens belongs to class k = capacity // r, whose bins hold exactly k pieces. A document gives full
sequences first; what is left is kept whole if it nearly fills its class's share of a bin, else a head of exactly
capacity // (k + 1) tokens is cut off and the rest goes on to a smaller class, so a bin is never padded by more than
`slack`. Every partition packs by itself: no shuffle, and at most k - 1 open pieces per class in memory. What stays
open at a partition's end (at most one bin per class) is joined and cut anew without padding: full sequences, then
sequences whose lengths are the powers of two in what remains.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY = 4096
END_ID = 2
#: Part of a bin's share that a piece may leave empty before it is cut.
SLACK = 1 / 32
#: Bytes of text that are encoded at a time, up to one text more.
SLICE = 4_000_000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 600_000
#: How the names of ids that end a word end.
WORD_END = "</w>"


def cuts(n_tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, class) of each piece of a document."""
    found = [(at, capacity, 1) for at in range(0, n_tokens - capacity + 1, capacity)]
    at = len(found) * capacity
    while rest := n_tokens - at:
        k = capacity // rest
        share = capacity // k
        if share - rest > slack * share:
            k += 1
            rest = capacity // k
        found.append((at, rest, k))
        at += rest
    return found


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of [begin, begin + length) of each pair, one after the other."""
    end = np.cumsum(length)
    return np.repeat(begin - end + length, length) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """Texts to 32-bit ids, by a vocabulary whose words never cross ASCII white space, whose letters end at punctuation,
    and which lower-cases what is no special token.

    Arrow splits a slice of texts and finds its distinct words; those are cut before a closing mark and lower-cased, and
    what is then new is encoded, once, and remembered. At cached_words all are forgotten."""

    def __init__(self, vocabulary: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cached_words = cached_words
        self.model = Tokenizer.from_file(vocabulary)
        names = self.model.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts. Plain words go in many at once, told apart by the ids that end words."""
        plain = pc.ascii_is_alpha(pa.array(parts, pa.string())).to_numpy(zero_copy_only=False)
        joined, rest = [parts[i] for i in np.flatnonzero(plain)], [parts[i] for i in np.flatnonzero(~plain)]
        encode = lambda x: [y.ids for y in self.model.encode_batch_fast(x, add_special_tokens=False)]
        runs = encode([" ".join(x) for x in itertools.batched(joined, 2000)])
        ids = np.fromiter(itertools.chain.from_iterable(runs), np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        size = np.diff(np.append(0, stops))
        if len(size) != len(joined):  # then one by one
            runs = encode(joined)
            ids, size = np.fromiter(itertools.chain.from_iterable(runs), np.uint32), np.array([len(x) for x in runs], np.int64)
        more = encode(rest)
        size = np.concatenate([size, np.array([len(x) for x in more], np.int64)])
        self.place.update(zip(joined + rest, range(len(self.place), len(self.place) + len(parts)), strict=True))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.concatenate([self.ids, ids, np.fromiter(itertools.chain.from_iterable(more), np.uint32)])

    def _places(self, parts: list[str]) -> np.ndarray:
        if new := list(dict.fromkeys(itertools.filterfalse(self.place.__contains__, parts))):
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def _parts(self, words: pa.Array) -> np.ndarray:
        """Two places for each word: of the word, or of what stands before its closing marks, and of these."""
        if len(self.place) > self.cached_words:
            self._forget()
        stem = pc.utf8_rtrim(words, ".,;:!?")
        stem = pc.if_else(pc.match_substring_regex(stem, "[A-Za-z]$"), stem, words)
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy()
        coded = pc.if_else(pc.match_substring(stem, "<|"), stem, pc.ascii_lower(stem)).dictionary_encode()
        first = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        second = np.full(len(words), self._places([""])[0])
        at = np.flatnonzero(marks)
        cut = words.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        second[at] = self._places([x[-n:] for x, n in zip(cut, marks[at].tolist(), strict=True)])
        return np.stack([first, second], 1)

    def __call__(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = self._parts(coded.dictionary)
        both = self.size[parts]
        ids, size = self.ids[_ranges(self.begin[parts].ravel(), both.ravel())], both.sum(1)
        begin, word = np.cumsum(size) - size, coded.indices.to_numpy()
        length = size[word]
        made = ids[_ranges(begin[word], length)]
        edges = np.append(0, np.cumsum(length))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [made[a:b] for a, b in itertools.pairwise(edges.tolist())]


_encoders: dict[tuple[str, int], Encoder] = {}


def _slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.LargeStringArray]:
    """Runs of texts of about `size` bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    held = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + size)) + 1
        yield texts[at:stop]
        at = stop


def _pack(vocabulary: str, capacity: int, slack: float, end_id: int, cached_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vocabulary, cached_words
        if key not in _encoders:
            _encoders[key] = Encoder(vocabulary, cached_words)
        encode = _encoders[key]
        end = np.array([end_id], "<u4")
        first = TaskContext.get().partitionId() << 33
        made, rows = 0, []
        open_pieces: dict[int, list[tuple]] = {}

        def close(pieces: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, data, total in pieces:
                rows.append((doc, start, len(data), zlib.crc32(data), total, first + made, at))
                at += len(data)
            made += 1

        def flushed() -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            out = pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows) if rows else [[]] * 7, strict=True)})
            rows.clear()
            return out

        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for part in _slices(batch.column(1)):
                for data in encode(part):
                    doc, data = next(docs), np.append(data, end)
                    total = len(data)
                    for start, length, k in cuts(total, capacity, slack):
                        held = open_pieces.setdefault(k, [])
                        held.append((doc, start, data[start : start + length], total))
                        if len(held) == k:
                            close(open_pieces.pop(k))
                if len(rows) > 50_000:
                    yield flushed()
        tail = [x for k in sorted(open_pieces) for x in open_pieces[k]]
        left = sum(len(x[2]) for x in tail)
        while left:
            room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, data, total = tail.pop(0)
                if len(data) > room:
                    tail.insert(0, (doc, start + room, data[room:], total))
                    data = data[:room]
                taken.append((doc, start, data, total))
                room -= len(data)
            close(taken)
        yield flushed()

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text gives a document of the end token alone; repeated rows are packed each; an empty table
    gives no sequences. Texts are encoded whole, one bounded slice of a batch at a time; other columns are not read.
    The strings of special tokens in a text give their single ids, as the tokenizer does. sequence_id holds the
    partition in its upper bits, so a retried task numbers its sequences as before. A Python worker remembers the ids of
    about cached_words words (some 200 bytes each), which changes its speed alone."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_pack(vocabulary, capacity, slack, end_id, cached_words), PIECES)
