"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves; the others are
merged by rank with a heap over a linked list of their bytes. Texts are split, encoded and decoded inside Spark's
tasks; the vocabulary (of fixed size, whatever the corpus) is all that is sent to them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens whose ids a Python worker remembers.
CACHED_PIECES = 600_000


class PerfectHash:
    """A minimal perfect hash of byte strings: key -> 0..n-1 by hash and displace, verified against the key."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 3)
        hashed = self._hash(keys)
        if len(set(hashed)) != n:
            raise ValueError("keys repeat or collide")
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashed):
            buckets[h % self.n_buckets].append(i)
        self.displace = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.value = [0] * n
        by_size = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        for b in by_size:
            own = buckets[b]
            if len(own) < 2:
                break
            d = 0
            while len(at := {self._slot(hashed[i], d) for i in own}) < len(own) or any(self.keys[x] is not None for x in at):
                d += 1
            self.displace[b] = d
            for i in own:
                self._place(self._slot(hashed[i], d), keys[i], i)
        free = (x for x in range(n) if self.keys[x] is None)
        for b in by_size:
            if len(buckets[b]) == 1:  # a bucket of one names its slot
                at = next(free)
                self.displace[b] = -at - 1
                self._place(at, keys[buckets[b][0]], buckets[b][0])

    @staticmethod
    def _hash(keys: list[bytes]) -> list[int]:
        return [xxhash.xxh3_64_intdigest(x) for x in keys]

    def _slot(self, hashed: int, d: int) -> int:
        return ((((hashed ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def _place(self, at: int, key: bytes, index: int) -> None:
        self.keys[at] = key
        self.value[at] = index

    def find(self, key: bytes) -> int:
        """The index of a key, -1 if it isn't one."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        at = -d - 1 if d < 0 else self._slot(h, d)
        return self.value[at] if self.keys[at] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of lowest rank, leftmost among equals, is merged until none is left."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        mid = after[i]
        if not mid or mid >= n or after[mid] != end:
            continue
        after[i], after[mid] = end, 0  # mid is gone
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes and decodes by ranks; remembers the ids of pre-tokens, up to CACHED_PIECES."""

    def __init__(self, tokens: list[bytes], pattern: str, whole: PerfectHash | None = None):
        import regex

        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.ranks = {x: i for i, x in enumerate(tokens)}
        self.whole = whole or PerfectHash(tokens)
        self.by_name = {str(i): x for i, x in enumerate(tokens)}
        self.known: dict[str, str] = {}

    def decimal(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        pieces = self.split(text)
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        known, find, ranks = self.known, self.whole.find, self.ranks
        for piece in set(pieces).difference(known):
            raw = piece.encode()
            whole = find(raw)
            known[piece] = str(whole) if whole >= 0 else " ".join(map(str, merge(raw, ranks)))
        return " ".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.decimal(text).split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by one space, SHA-256 of the decoded bytes."""
        ids = self.decimal(text)
        names = ids.split()
        back = b"".join(map(self.by_name.__getitem__, names))
        return len(names), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


_codecs: dict[str, Codec] = {}


class _Vocabulary:
    """The tokens and their perfect hash, built once and broadcast; of the vocabulary's size, whatever the corpus."""

    def __init__(self, df: DataFrame, path: str, pattern: str):
        tokens = read_ranks(path)
        self.pattern = pattern
        self.name = hashlib.sha256(b"\n".join([pattern.encode(), *tokens])).hexdigest()
        self.sent = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def codec(self) -> Codec:
        """The worker's codec, made when it first meets this vocabulary."""
        if self.name not in _codecs:
            _codecs.clear()
            tokens, whole = self.sent.value
            _codecs[self.name] = Codec(tokens, self.pattern, whole)
        return _codecs[self.name]


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, the digests of nothing. Every row gives one row, repeated ones too; other
    columns are not read."""
    vocabulary = _Vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            found = [codec.digests(x.as_py() or "") for x in batch.column(1)]
            n, ids, back = zip(*found) if found else ((), (), ())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids themselves; null or empty texts give an empty array."""
    vocabulary = _Vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array([codec.encode(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids give no bytes."""
    vocabulary = _Vocabulary(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "data": pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, data binary")
