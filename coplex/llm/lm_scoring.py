"""Language-model scoring: causal self-attention on subword ids, mixed with word counts of the whole corpus.

The attention model (one head, a fixed vector per id) predicts the class of the next subword id from overlapping
windows: a window holds 2 * HALF positions and scores its second half, so every id is scored once, with HALF to
2 * HALF - 1 ids before it. An id's share of its class comes from the id counts of all training documents. A word's
probability mixes the product over its subword ids with its smoothed frequency in all training documents.

All of it is gathered in Spark. Each text is split into words once: documents are dealt into blocks of bounded bytes, whose
texts are written as numbers of the block's distinct words, with these words, their counts and subword ids. A block's words
go into BUCKETS by a hash of their bytes, a row for each bucket. A shuffle by bucket adds the counts up over the corpus, and one
by block brings back the totals of those of its words that other blocks have too; a block knows the others' counts itself. The
totals give N and V.
The attention model learns from every training document, whole: their ids are written too, and what stands around each id is
summed, which gives its count, vector and class; two passes of Adam over these ids, on shares of the documents that make up
the whole, start every task from the same weights and average what the tasks end with. What comes to the driver has the
vocabulary's size. Scoring is one pass over the blocks; it sums each text for every weight of MIXES, and takes the weight that
makes all training documents, with their own words and end left out of the counts, likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .common import shuffle_partitions, staged

#: Bytes of text in a block, up to one text more.
BLOCK_BYTES = 32 << 20
HALF, DIM, CLASSES, VECTOR = 8, 8, 64, 24
#: Steps of a task at least (it repeats its last chunk if it has fewer batches), windows of a step, rate.
STEPS, BATCH, RATE = 500, 128, 0.01
#: What distinct words are dealt into, by their bytes, to add their counts up; a power of two. 30 GB have a million words of
#: blocks in each.
BUCKETS = 1024
#: Distinct words that are encoded together.
TOGETHER = 4096
#: Ids that are made or learned from at a time, up to one text more.
CHUNK_IDS = 1 << 20
#: Places on either side that count as around an id, and ids whose surroundings are summed at a time.
AROUND, NEAR_IDS = 20, 50_000
#: The first round of gradients takes one of this many training documents, the second all others.
ROUND_SHARE = 8
#: Random code of an id.
CODE = 24
#: Windows that are attended to at a time, and words of a slice of texts that are scored at a time.
WINDOWS, SLICE_WORDS = 512, 80_000
#: Most partitions that blocks are dealt to, beyond the session's own number.
MOST_PARTITIONS = 10_000
#: Weights of the word counts that are tried, on all training documents.
MIXES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null identifier is a training row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Coded:
    """Texts as numbers of distinct words: text i has numbers[edges[i]:edges[i + 1]]."""

    words: pa.LargeStringArray
    numbers: np.ndarray
    edges: np.ndarray


def coded(texts: pa.Array) -> Coded:
    """Words of texts without nulls, lower-cased in A-Z."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))  # a slice that is cast first loses its place
    found = split.flatten().dictionary_encode()
    numbers, edges = found.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
    empty = pc.index(found.dictionary, "").as_py()
    if empty >= 0:  # white space at a text's ends gives empty words
        full = numbers != empty
        edges = np.append(0, np.cumsum(full))[edges]
        numbers = numbers[full]
    return Coded(found.dictionary, numbers, edges)


def buckets(words: pa.LargeStringArray) -> np.ndarray:
    """The bucket of each word, none empty: by its length, its first, middle and last four bytes."""
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, np.int64)[words.offset : words.offset + len(words) + 1]
    data, begin, end = np.frombuffer(data, np.uint8), edges[:-1], edges[1:]
    key = (end - begin).astype(np.uint64)
    for at in (begin, (begin + end) >> 1, *(np.maximum(end - k, begin) for k in (1, 2, 3, 4))):
        key *= np.uint64(1099511628211)
        key ^= data.take(at)
    key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of [begin, begin + length) of each pair, one after the other."""
    end = np.cumsum(length)
    return np.repeat(begin - end + length, length) + np.arange(end[-1] if len(end) else 0)


class Subwords:
    """Ids of lower-cased words, each with a space before it; `start` marks the ids that begin a word."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import tiktoken

        self.end, self.pad, self.size = len(tokens), len(tokens) + 1, len(tokens) + 2
        self.model = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
        self.start = np.array([x[:1] == b" " for x in tokens] + [True, True])

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one word after the other, and the number of each word's ids."""
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), TOGETHER):
            listed = words[at : at + TOGETHER].to_numpy(zero_copy_only=False).tolist()
            found = self.model.encode_to_numpy(" " + " ".join(listed), disallowed_special=()).astype(np.int64)
            first = np.flatnonzero(self.start[found])
            if len(first) == len(listed) and first[0] == 0 and "" not in listed:
                ids.append(found)
                lengths.append(np.diff(np.append(first, len(found))))
            else:
                apart = [self.model.encode_ordinary(" " + x) if x else [] for x in listed]
                ids += [np.array(x, np.int64) for x in apart]
                lengths.append(np.array([len(x) for x in apart], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)


def windows(sequences: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of HALF inputs, rows of HALF targets, which rows are scored): row r attends to rows r - 1 and r.

    A sequence is its ids with the end id on both sides; a row of padding stands before each one."""
    length = np.array([len(s) - 1 for s in sequences])
    rows = 1 + -(-length // HALF)
    begin = np.cumsum(rows) - rows
    inputs, targets = np.full((2, rows.sum() * HALF), pad, sequences[0].dtype)
    for s, at, n in zip(sequences, ((begin + 1) * HALF).tolist(), length.tolist(), strict=True):
        inputs[at : at + n], targets[at : at + n] = s[:-1], s[1:]
    scored = np.ones(rows.sum(), bool)
    scored[begin] = False
    return inputs.reshape(-1, HALF), targets.reshape(-1, HALF), scored


def paired(rows: np.ndarray) -> np.ndarray:
    """(windows, 2 * HALF, columns): each two neighbours of what is given by rows of HALF positions, in place."""
    step, column = rows.strides
    return np.ndarray((len(rows) // HALF - 1, 2 * HALF, rows.shape[1]), rows.dtype, rows, strides=(HALF * step, step, column))


def stacked(rows: np.ndarray) -> np.ndarray:
    """Rows of positions as HALF pieces: products of a million multiplications and more take longer a row than smaller ones."""
    return rows.reshape(HALF, -1, rows.shape[1])


@dataclass
class Model:
    """vectors: one per id; class_of: each id's class; share: log of each id's share of its class."""

    vectors: np.ndarray
    class_of: np.ndarray
    share: np.ndarray
    weights: dict[str, np.ndarray]
    pad: int

    def inner(self) -> np.ndarray:
        """Query, key, value and direct part of every id."""
        return self.vectors @ self.weights["W"]

    def hidden(self, inputs: np.ndarray, starts: range) -> list[tuple[np.ndarray, np.ndarray]]:
        """The windows of rows of ids that hold padding, counted from each start, and what hides it."""
        blank = inputs == self.pad
        full, some = blank.all(1), blank.any(1)
        some = np.flatnonzero(some[:-1] | some[1:])
        found = np.concatenate([blank[some], blank[some + 1] & ~full[some + 1, None]], 1)
        found = np.where(found, np.float32(-1e9), np.float32(0))[:, None, :]
        edges = np.searchsorted(some, np.append(starts, len(inputs)) - 1)
        return [(some[b:e] - at + 1, found[b:e]) for at, b, e in zip(starts, edges[:-1], edges[1:], strict=True)]

    def forward(self, inner: np.ndarray, keys: np.ndarray, hidden: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inner: parts of rows of ids; keys: the windows' keys, a column for each; hidden: windows with padding, and what
        hides it; gives the attention, what the classes are read from, and their logits less c, after each position of rows
        1 and on."""
        w, n = self.weights, len(inner) // HALF - 1
        made = inner.reshape(n + 1, HALF, 4 * DIM)[1:]
        a = made[..., :DIM] @ keys
        a += w["bias"][AGE] + FUTURE
        if len(hidden[0]):
            a[hidden[0]] += hidden[1]
        if a.max(initial=0) > 60:
            np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        total = a.reshape(-1, 2 * HALF) @ SPREAD
        total += np.float32(1e-20)
        a /= total.reshape(a.shape)
        h = np.empty((n, HALF, 2 * DIM), np.float32)
        np.matmul(a, paired(inner)[..., 2 * DIM : 3 * DIM], out=h[..., :DIM])
        h[..., DIM:] = made[..., 3 * DIM :]
        np.tanh(h, out=h)
        # |h| < 1, so logits are bounded by the weights
        return a, h, (stacked(h.reshape(-1, 2 * DIM)) @ w["O"]).reshape(-1, CLASSES)

    def log_probabilities(self, sequences: list[np.ndarray], inner: np.ndarray) -> np.ndarray:
        """Natural log-probability of every id after the first of each sequence, one after the other."""
        inputs, targets, _ = windows(sequences, self.pad)
        starts = range(1, len(inputs), WINDOWS)
        hidden, out = self.hidden(inputs, starts), []
        times, share = np.exp(self.weights["c"]), self.share + self.weights["c"][self.class_of]
        for k, at in enumerate(starts):
            goal = targets[at : at + WINDOWS].ravel()
            found = inner.take(inputs[at - 1 : at + WINDOWS].ravel(), 0)
            keys = np.ascontiguousarray(paired(found)[..., DIM : 2 * DIM].transpose(0, 2, 1))
            _, _, logits = self.forward(found, keys, hidden[k])
            logs = logits.ravel().take(np.arange(0, logits.size, CLASSES) + self.class_of.take(goal))
            logs += share.take(goal)
            logs -= np.log(np.exp(logits, out=logits) @ times)
            out.append(logs[goal != self.pad])
        return np.concatenate(out).astype(np.float64)


#: Age of each key for each query of a window's second half, and what lies in its future.
AGE = np.maximum(HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)[None, :], 0)
FUTURE = np.where(HALF + np.arange(HALF)[:, None] < np.arange(2 * HALF)[None, :], np.float32(-1e9), np.float32(0))

#: Gives a row's sum in each of its columns.
SPREAD = np.ones((2 * HALF, 2 * HALF), np.float32)

WEIGHTS = ("W", "bias", "O", "c")


def flattened(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in WEIGHTS])


def shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of flat as weights, of shapes as in like."""
    ends = np.cumsum([like[k].size for k in WEIGHTS])
    return {k: x.reshape(like[k].shape) for k, x in zip(WEIGHTS, np.split(flat, ends[:-1]), strict=True)}


class Trainer:
    """Adam on batches of neighbouring windows."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.steps = model, rate, 0
        self.flat = flattened(model.weights)
        model.weights = shaped(self.flat, model.weights)
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def learn(self, sequences: list[np.ndarray], rng: np.random.Generator) -> None:
        """One step for each batch of the sequences' windows, in random order."""
        inputs, targets, scored = windows(sequences, self.model.pad)
        starts = range(1, len(inputs), BATCH)
        hidden, real = self.model.hidden(inputs, starts), (scored[:, None] & (targets != self.model.pad)).astype(np.float32)
        for k in rng.permutation(len(starts)):
            at = starts[k]
            goal = self.model.class_of.take(targets[at : at + BATCH].ravel())
            self._step(inputs[at - 1 : at + BATCH], hidden[k], goal, real[at : at + BATCH].ravel())

    def _step(self, rows: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], goal: np.ndarray, real: np.ndarray) -> None:
        """rows: ids; hidden: as in forward; goal, real: class of each target of rows 1 and on, and whether it counts."""
        model, w, n = self.model, self.model.weights, len(rows) - 1
        self.steps += 1
        x = model.vectors.take(rows.ravel(), 0)
        inner = x @ w["W"]
        across = paired((w["W"][:, DIM : 3 * DIM].T @ x.T).T).transpose(0, 2, 1)
        a, h, d = model.forward(inner, across[:, :DIM], hidden)
        h = h.reshape(-1, 2 * DIM)
        # each row of the logits' slope is d times scale, each column times that class's times
        np.exp(d, out=d)
        times = np.exp(w["c"])
        total = d @ times
        scale = real / (max(1, real.sum()) * total)
        total /= times.take(goal)
        d.reshape(-1)[np.arange(0, d.size, CLASSES) + goal] -= total
        wide = scale.repeat(2 * DIM).reshape(-1, 2 * DIM)
        dh = (stacked(d) @ np.ascontiguousarray((w["O"] * times).T)).reshape(-1, 2 * DIM)
        dh *= wide
        wide *= h
        last = np.concatenate([(stacked(wide).transpose(0, 2, 1) @ stacked(d)).sum(0), (scale @ d)[None]])
        last *= times
        h *= h
        dh *= np.subtract(np.float32(1), h, out=h)
        dh = dh.reshape(n, HALF, 2 * DIM)
        da_v = dh[..., :DIM]
        ds = da_v @ across[:, DIM:]
        ds *= a
        less = (ds.reshape(-1, 2 * HALF) @ SPREAD).reshape(a.shape)
        less *= a
        ds -= less
        made = np.empty((n + 1, HALF, 4 * DIM), np.float32)
        made[0, :, :DIM] = made[0, :, 3 * DIM :] = 0
        np.matmul(ds, paired(inner)[..., DIM : 2 * DIM], out=made[1:, :, :DIM])
        made[1:, :, 3 * DIM :] = dh[..., DIM:]
        # a row is met as the second half of a window and as the first half of the next
        for at, both in ((DIM, ds.transpose(0, 2, 1) @ inner.reshape(n + 1, HALF, -1)[1:, :, :DIM]), (2 * DIM, a.transpose(0, 2, 1) @ da_v)):
            both[:-1, HALF:] += both[1:, :HALF]
            made[0, :, at : at + DIM] = both[0, :HALF]
            made[1:, :, at : at + DIM] = both[:, HALF:]
        slope = np.concatenate([(x.T @ made.reshape(-1, 4 * DIM)).ravel(), np.bincount(AGE.ravel(), np.ones(n, np.float32) @ ds.reshape(n, -1), 2 * HALF), last.ravel()], dtype=np.float32)
        self.mean *= np.float32(0.9)
        self.mean += np.float32(0.1) * slope
        self.square *= np.float32(0.99)
        slope *= slope
        slope *= np.float32(0.01)
        self.square += slope
        rate = self.rate / np.sqrt(1 + self.steps / STEPS) / (1 - 0.9**self.steps)
        root = self.square * np.float32(1 / (1 - 0.99**self.steps))
        np.sqrt(root, out=root)
        root += np.float32(1e-8)
        np.divide(self.mean, root, out=root)
        root *= np.float32(rate)
        self.flat -= root


def _add_neighbours(sequences: list[np.ndarray], code: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Adds, for every id, the codes of the ids around it, before it and after it to total (a row for each of these
    numbers), its places to count."""
    size = len(count)
    flat = np.concatenate(sequences)
    places = np.bincount(flat, minlength=size)
    seen = np.flatnonzero(places)
    n, slot = len(seen), np.zeros(size, np.int64)
    slot[seen] = np.arange(n)
    own, sums, code = slot[flat], np.zeros((3 * CODE, n)), np.append(code[seen], np.zeros((1, CODE), np.float32), 0).T.copy()
    # sequences begin and end with the end id, so what lies beyond a sequence is that too
    pairs, times = np.unique(own * n + np.roll(own, -1), return_counts=True)
    before, after = np.divmod(pairs, n)
    for i in range(CODE):
        sums[CODE + i] = np.bincount(after, times * code[i].take(before), n)
        sums[2 * CODE + i] = np.bincount(before, times * code[i].take(after), n)
    held = np.cumsum([len(x) for x in sequences])
    at = 0
    while at < len(sequences):
        stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + NEAR_IDS)) + 1
        apart = np.full(AROUND, n)
        padded = np.concatenate([apart, *(y for x in sequences[at:stop] for y in (slot[x], apart))])
        middle = padded[AROUND:-AROUND]
        share = 3 / np.maximum(_around((padded < n).astype(np.float32)), 1)
        for i in range(CODE):
            sums[i] += np.bincount(middle, share * _around(code[i].take(padded)), n + 1)[:n]
        at = stop
    total[:, seen] += sums
    count += places


def _around(x: np.ndarray) -> np.ndarray:
    """Sums of x from AROUND places before each place to AROUND after it, where there are as many; by runs of doubled length."""
    width = 2 * AROUND + 1
    n, at, run, held, out = len(x) - width + 1, 0, 1, x, 0
    while run <= width:
        if width & run:
            out = out + held[at : at + n]
            at += run
        run *= 2
        if run <= width:
            held = held[: -(run // 2)] + held[run // 2 :]
    return out


def _vectors(total: np.ndarray, count: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A vector per id from its neighbours in the training documents: randomly projected counts of the ids around, the
    id before and the id after, scaled and cut to VECTOR principal directions. Ids that they lack have the mean."""
    out = np.zeros((len(count), VECTOR), np.float32)
    seen = count > 0
    if not seen.any():
        return out
    found = total[seen] / (count[seen] + 1)[:, None]
    found = np.concatenate([found, 0.5 * start[seen][:, None]], 1)
    mean = found.mean(0)
    _, axes = np.linalg.eigh((found - mean).T @ (found - mean))
    cut = (found - mean) @ axes[:, ::-1][:, :VECTOR]
    out[seen] = cut / (cut.std(0) + 1e-3)
    return out


def _classes(vectors: np.ndarray, count: np.ndarray, end: int, rounds: int = 12) -> np.ndarray:
    """CLASSES - 1 classes of ids by k-means weighted with the root of their counts; the end id is its own class."""
    rng = np.random.default_rng(2)
    seen = np.flatnonzero((count > 0) & (np.arange(len(count)) != end))
    out = np.full(len(count), 0)
    out[end] = CLASSES - 1
    if not len(seen):
        return out
    x, weight = vectors[seen], np.sqrt(count[seen])
    centre = x[rng.choice(len(seen), CLASSES - 2, p=weight / weight.sum(), replace=len(seen) < CLASSES)]
    for _ in range(rounds):
        near = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
        mass = np.bincount(near, weight, CLASSES - 2)
        for k in range(x.shape[1]):
            centre[:, k] = np.where(mass > 0, np.bincount(near, weight * x[:, k], CLASSES - 2) / np.maximum(mass, 1e-9), centre[:, k])
    out[seen] = near + 1  # class 0 is for what the training documents lack
    return out


def new_model(total: np.ndarray, count: np.ndarray, subwords: Subwords) -> Model:
    vectors = _vectors(total, count, subwords.start)
    rng = np.random.default_rng(3)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(VECTOR, 4 * DIM), "bias": np.zeros(2 * HALF, np.float32), "O": draw(2 * DIM, CLASSES), "c": np.zeros(CLASSES, np.float32)}
    return Model(vectors, _classes(vectors, count, subwords.end), np.zeros(subwords.size, np.float32), w, subwords.pad)


def shares(counts: np.ndarray, class_of: np.ndarray, end: int) -> np.ndarray:
    """Log of each id's share of its class, one added to every count."""
    smooth = np.log(counts + 1.0) - np.log(np.bincount(class_of, counts + 1.0, CLASSES)[class_of])
    smooth[end] = 0
    return smooth.astype(np.float32)


#: Rows are of four kinds. Of a text: numbers of its words and, to learn from, its sequence of ids. Of a block: ids, lengths
#: (ids of each word) and counts (in training texts) of its distinct words, in the order of their numbers. Of a bucket of these
#: words: words, joined by spaces, their numbers and counts. Of a task: sums of what stands around an id in its training texts,
#: its places n.
CODED = "doc_id long, train boolean, block long, numbers binary, first boolean, sequence binary, ids binary, lengths binary, counts binary, bucket long, words string, n long, id long, sums binary"
CODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("block", pa.int64()), ("numbers", pa.binary()), ("first", pa.bool_()), ("sequence", pa.binary()), ("ids", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()), ("bucket", pa.int64()), ("words", pa.string()), ("n", pa.int64()), ("id", pa.int64()), ("sums", pa.binary())])


def _rows(**columns) -> Iterator[pa.RecordBatch]:
    """Rows of CODED, null where no column is given."""
    made = {k: pa.array(v, CODED_SCHEMA.field(k).type) if not isinstance(v, pa.Array) else v.cast(CODED_SCHEMA.field(k).type) for k, v in columns.items()}
    n = len(next(iter(made.values())))
    batch = pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in CODED_SCHEMA], schema=CODED_SCHEMA)
    for at in range(0, n, 100_000):
        yield batch.slice(at, 100_000)


def _bucketed(block: int, words: pa.LargeStringArray, length: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The block's rows of CODED of its words' buckets."""
    own = np.flatnonzero(length)  # all but the empty word, which white space at a text's ends gives
    if not len(own):
        return
    bucket = buckets(words.take(pa.array(own)))
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    own, bucket = own[order].astype(np.int32), bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(own)), pa.int32()), words.take(pa.array(own)).cast(pa.string()))
    yield from _rows(
        block=np.full(len(starts), block),
        bucket=bucket[starts],
        words=pc.binary_join(listed, " "),
        numbers=[x.tobytes() for x in np.split(own, starts[1:])],
        counts=[x.tobytes() for x in np.split(counts[own], starts[1:])],
    )


#: Of each block, its words (home, numbers) that other blocks have too, with their counts everywhere. Of a bucket: the sum of
#: its words' counts n, and how many words v have any.
TOTALS = "home long, numbers binary, counts binary, n long, v long"
TOTALS_SCHEMA = pa.schema([("home", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _totals(rows: pa.Table) -> pa.Table:
    """Adds up the counts of one bucket's words, each of which every block has once."""
    words = pc.ascii_split_whitespace(rows["words"].combine_chunks().cast(pa.large_string())).flatten().dictionary_encode()
    word, numbers = words.indices.to_numpy(), rows["numbers"].to_pylist()
    edges = np.append(0, np.cumsum([len(x) // 4 for x in numbers]))
    number, n = np.frombuffer(b"".join(numbers), np.int32), np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int64)
    total = np.zeros(len(words.dictionary), np.int64)
    np.add.at(total, word, n)
    count = total[word]
    other = np.flatnonzero(count > n)
    cut = np.searchsorted(other, edges[1:-1])
    number, count = number[other], count[other]
    return pa.table(
        [
            pa.concat_arrays([*rows["block"].chunks, pa.nulls(1, pa.int64())]),
            pa.array([*(x.tobytes() for x in np.split(number, cut)), None], pa.binary()),
            pa.array([*(x.tobytes() for x in np.split(count, cut)), None], pa.binary()),
            pa.array([None] * len(numbers) + [int(total.sum())], pa.int64()),
            pa.array([None] * len(numbers) + [int((total > 0).sum())], pa.int64()),
        ],
        schema=TOTALS_SCHEMA,
    )


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _code(tokens, pattern: str, block_bytes: int):
    """Deals texts to blocks and gives the blocks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(tokens, pattern)
        kind, edge = _id_type(subwords.size), np.array([subwords.end])
        code = np.random.default_rng(1).normal(size=(subwords.size, CODE)).astype(np.float32)
        total, seen = np.zeros((3 * CODE, subwords.size)), np.zeros(subwords.size, np.int64)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            texts = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            doc, train, first = (texts[k].chunk(0) for k in ("doc_id", "train", "first"))
            found, learned = coded(texts["text"].chunk(0)), train.to_numpy(zero_copy_only=False)
            numbers, edges = found.numbers.astype(np.int32), found.edges
            ids, length = subwords(found.words)
            counts = np.bincount(numbers[np.repeat(learned, np.diff(edges))], minlength=len(length))
            yield from _rows(block=[block], ids=[ids.astype(kind).tobytes()], lengths=[length.astype(np.int32).tobytes()], counts=[counts.tobytes()])
            yield from _bucketed(block, found.words, length, counts)
            begins = np.cumsum(length) - length
            ends = np.append(0, np.cumsum(length[numbers]))[edges]
            low = 0
            while low < len(learned):
                high = min(int(np.searchsorted(ends[1:], ends[low] + CHUNK_IDS)) + 1, len(learned))
                some, sizes = numbers[edges[low] : edges[high]], np.diff(edges[low : high + 1])
                flat = ids[ranges(begins[some], length[some])]
                sequences = [np.concatenate([edge, x, edge]) if t else None for x, t in zip(np.split(flat, ends[low + 1 : high] - ends[low]), learned[low:high].tolist())]
                if any(learned[low:high]):
                    _add_neighbours([x for x in sequences if x is not None], code, total, seen)
                yield from _rows(
                    doc_id=doc[low:high],
                    train=train[low:high],
                    block=np.full(len(sizes), block),
                    numbers=[x.tobytes() for x in np.split(some, np.cumsum(sizes)[:-1])],
                    first=first[low:high],
                    sequence=[None if x is None else x.astype(kind).tobytes() for x in sequences],
                )
                low = high

        for batch in batches:
            sums = size + np.cumsum(pc.binary_length(batch["text"]).to_numpy())
            at = 0
            while at < len(batch):
                stop = int(np.searchsorted(sums, block_bytes)) + 1
                held.append(batch.slice(at, stop - at))
                if stop <= len(batch):
                    yield from rows()
                    block, sums = block + 1, sums - sums[stop - 1]
                size, at = int(sums[-1]), stop
        if held:
            yield from rows()
        some = np.flatnonzero(seen)
        yield from _rows(id=some, n=seen[some], sums=[x.tobytes() for x in total.T[some].astype(np.float32)])

    return run


def _slices(texts: pa.Array, most_bytes: int) -> Iterator[slice]:
    """Neighbouring rows of most_bytes, up to one row more."""
    held = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + most_bytes)) + 1
        yield slice(at, stop)
        at = stop


SUMS = "id long, n long, sums binary"


def _sums(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    ids = np.flatnonzero(count)
    return pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(count[ids], pa.int64()), "sums": pa.array([x.tobytes() for x in total[ids].astype(np.float32)], pa.binary())})


def _add_sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((size, 3 * CODE)), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            np.add.at(count, ids, batch.column(1).to_numpy())
            np.add.at(total, ids, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 3 * CODE))
        yield _sums(total, count)

    return run


def _learn(model_sent, rate: float):
    """A task's weights after its sequences, times their batches, and the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = model_sent.value
        model = Model(sent.vectors, sent.class_of, sent.share, sent.weights, sent.pad)
        trainer, rng, sequences = Trainer(model, rate), np.random.default_rng(0), []
        kind = _id_type(len(model.share))
        for batch in batches:
            for some in _slices(batch.column(0), CHUNK_IDS * kind().itemsize):
                sequences = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(0)[some]]
                trainer.learn(sequences, rng)
        if n := trainer.steps:
            while trainer.steps < STEPS:
                trainer.learn(sequences, rng)
            yield pa.record_batch({"n": pa.array([n], pa.int64()), "weights": pa.array([(n * trainer.flat.astype(np.float64)).tobytes()], pa.binary())})

    return run


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for batch in batches:
        n += sum(batch.column(0).to_pylist())
        for x in batch.column(1).to_pylist():
            total = total + np.frombuffer(x)
    if n:
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def learn_model(texts: DataFrame, n_ends: int, subwords: Subwords) -> Model:
    """The attention model of the sequences of all training texts, and of the sums of what stands around their ids."""
    spark = texts.sparkSession
    found = texts.filter("sums IS NOT NULL").select("id", "n", "sums")
    found = found.repartition("id").mapInArrow(_add_sums(subwords.size), SUMS).toArrow()  # of the vocabulary's size
    total, count = np.zeros((subwords.size, 3 * CODE), np.float32), np.zeros(subwords.size)
    ids = found["id"].to_numpy()
    count[ids] = found["n"].to_numpy()
    total[ids] = np.frombuffer(b"".join(found["sums"].to_pylist()), np.float32).reshape(-1, 3 * CODE)
    model = new_model(total, count, subwords)
    once = np.where(np.arange(subwords.size) == subwords.end, n_ends, count)  # the end id stands on both sides of a sequence
    model.share = shares(once, model.class_of, subwords.end)
    for rate, rows in ((RATE, F.col("first")), (RATE / 2, ~F.col("first"))):
        learned = texts.filter("sequence IS NOT NULL").filter(rows).select("sequence").mapInArrow(_learn(spark.sparkContext.broadcast(model), rate), "n long, weights binary")
        for r in learned.repartition(1).mapInArrow(_add_weights, "n long, weights binary").collect():  # one row
            model.weights = shaped((np.frombuffer(bytes(r["weights"])) / r["n"]).astype(np.float32), model.weights)
    return model


_made: dict[str, Subwords] = {}


def _subwords(tokens, pattern: str) -> Subwords:
    if pattern not in _made:
        _made[pattern] = Subwords(tokens.value, pattern)
    return _made[pattern]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

#: Mixed holds a text's log-probability for each of MIXES; gains, of one more row for each block, such sums of training texts.
SUMMED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, mixed array<double>, gains array<double>"
SUMMED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("mixed", pa.list_(pa.float64())), ("gains", pa.list_(pa.float64()))])


def _mixed(by_ids: np.ndarray, by_words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of words' log-probabilities for each of MIXES (columns), of the texts that begin at starts."""
    ratio = np.exp(np.clip(by_ids - by_words, -80, 80)).astype(np.float32)
    base = np.add.reduceat(by_words, starts)
    sums = [np.add.reduceat(np.log(np.float32(w) + np.float32(1 - w) * ratio), starts, dtype=np.float64) for w in MIXES]
    return base[:, None] + np.stack(sums, 1)


def _repeats(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each number occurs in its own text; texts are runs of sizes."""
    order = np.argsort(key := numbers + (int(numbers.max(initial=0)) + 1) * np.repeat(np.arange(len(sizes)), sizes))
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    times = np.diff(np.append(first, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _score(model_sent, tokens, pattern: str, n_total: int, n_distinct: int, n_ends: int):
    def run(texts: pa.Table, elsewhere: pa.Table) -> pa.Table:
        subwords, model = _subwords(tokens, pattern), model_sent.value
        inner = model.inner()
        distinct = texts.filter(pc.is_valid(texts["lengths"])).select(["ids", "lengths", "counts"]).to_pylist()[0]
        ids, length = np.frombuffer(distinct["ids"], _id_type(subwords.size)), np.frombuffer(distinct["lengths"], np.int32).astype(np.int64)
        count = np.frombuffer(distinct["counts"], np.int64).astype(np.float64)
        # words that other blocks have too
        count[np.frombuffer(b"".join(elsewhere["numbers"].to_pylist()), np.int32)] = np.frombuffer(b"".join(elsewhere["counts"].to_pylist()), np.int64)
        texts = texts.filter(pc.is_valid(texts["numbers"]))
        doc, train = texts["doc_id"].combine_chunks(), texts["train"].to_numpy()
        numbers = texts["numbers"].to_pylist()
        n_words = np.array([len(x) // 4 for x in numbers])
        numbers, edges = np.frombuffer(b"".join(numbers), np.int32), np.append(0, np.cumsum(n_words))
        # the end is one word more
        ids, length, count = np.append(ids, ids.dtype.type(subwords.end)), np.append(length, 1), np.append(count, float(n_ends))
        first = np.cumsum(length) - length
        scale = np.log(n_total + n_distinct + 1.0)
        gains = np.zeros(len(MIXES))
        logs = np.log(count + 1)
        edge, made = np.array([subwords.end], ids.dtype), []
        held = np.cumsum(n_words + 1)
        low = 0
        while low < len(n_words):
            high = int(np.searchsorted(held, (held[low - 1] if low else 0) + SLICE_WORDS)) + 1
            own, sizes = numbers[edges[low] : edges[min(high, len(n_words))]], n_words[low:high]
            ends = np.cumsum(sizes + 1) - 1  # where each text's end stands among its words
            word = np.ones(len(own) + len(sizes), bool)
            word[ends] = False
            all_words = np.full(len(word), len(length) - 1)
            all_words[word] = own
            pieces = length.take(all_words)
            begins = np.cumsum(pieces) - pieces
            flat = ids.take(ranges(first.take(all_words), pieces))
            sequences = [np.concatenate([edge, x]) for x in np.split(flat, begins[ends][:-1] + 1)]
            by_ids = np.add.reduceat(model.log_probabilities(sequences, inner), begins)
            c = count.take(all_words)
            by_words = logs.take(all_words) - scale
            starts = ends - sizes
            base, known, mixed = np.add.reduceat(by_words, starts), np.add.reduceat((c > 0).astype(np.int64), starts), _mixed(by_ids, by_words, starts)
            if train[low:high].any():  # each training text's own words and end are taken off the counts
                mine = np.ones(len(word))
                mine[word] = _repeats(own, sizes)
                left = np.log(np.maximum(c - mine, 0) + 1) - scale
                gains += _mixed(by_ids, left, starts)[train[low:high]].sum(0)
            size = len(sizes)
            made.append(pa.table([doc.slice(low, size), pa.array(~train[low:high]), pa.array(sizes + 1), pa.array(known), pa.array(base / np.log(10)), pa.array(list(mixed / np.log(10)), pa.list_(pa.float64())), pa.nulls(size, pa.list_(pa.float64()))], schema=SUMMED_SCHEMA))
            low = high
        made.append(pa.table([*(pa.nulls(1, x.type) for x in list(SUMMED_SCHEMA)[:-1]), pa.array([gains.tolist()], pa.list_(pa.float64()))], schema=SUMMED_SCHEMA))
        return pa.concat_tables(made)

    return run


def lm_scores(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the text's words, lower-cased in A-Z, and one end; scores are log10 probabilities of the whole text.
    A null text counts as empty, and is scored for its end. Repeated rows each count and are each scored. An empty
    table gives an empty result; other columns are not read. Counts do not depend on how files are split."""
    spark = docs.sparkSession
    tokens = read_ranks(ranks_path)
    subwords, sent = Subwords(tokens, pattern), spark.sparkContext.broadcast(tokens)  # of the vocabulary's size
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~held_out(F.col(id_col))).alias("train"))
    slim = slim.withColumn("first", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(ROUND_SHARE)) == 0)
    texts = staged(slim.mapInArrow(_code(sent, pattern, block_bytes), CODED), "coded")  # so each text is read once
    words = texts.filter("bucket IS NOT NULL").select("block", "bucket", "words", "numbers", "counts")
    words = staged(words.groupBy("bucket").applyInArrow(_totals, TOTALS), "words")
    elsewhere = words.filter("length(numbers) > 0").select("home", "numbers", "counts")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_ends = texts.filter("sequence IS NOT NULL").count()
    n_total, n_distinct = totals["n"] + n_ends, totals["v"] + (n_ends > 0)
    model = learn_model(texts, n_ends, subwords)
    score = _score(spark.sparkContext.broadcast(model), sent, pattern, n_total, n_distinct, n_ends)
    # a few partitions for each block, as several blocks that meet in one make a long task
    n_parts = max(shuffle_partitions(spark), min(MOST_PARTITIONS, 4 * texts.filter("lengths IS NOT NULL").count()))
    needed = texts.filter("(numbers IS NOT NULL OR lengths IS NOT NULL) AND bucket IS NULL").select("doc_id", "train", "block", "numbers", "ids", "lengths", "counts")
    needed, elsewhere = needed.repartition(n_parts, "block"), elsewhere.repartition(n_parts, "home")
    summed = staged(needed.groupBy("block").cogroup(elsewhere.groupBy("home")).applyInArrow(score, SUMMED), "summed")
    gains = summed.filter("gains IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("gains")[i]), F.lit(0.0)) for i in range(len(MIXES)))).first()
    best = max(range(len(MIXES)), key=lambda i: (gains[i], -abs(MIXES[i] - 0.5)))
    return summed.filter("gains IS NULL").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", F.col("mixed")[best].alias("score"))
