"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of PASSAGE bytes of its whole text). Each passage is encoded from what its bytes
look like, a gated attention learned from document labels alone weighs the passages, and the weighted passage
representation is scored. The model is fitted on a bounded sample of labelled documents (SAMPLE_DOCS, taken by hash of
the identifier, so the same at every run) whose passages Spark encodes; scoring is one pass over the documents, with a
model of a few kilobytes inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 480
#: Most labelled documents that the model is fitted on.
SAMPLE_DOCS = 4000
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 300, 0.02, 1e-3
#: Bytes of text that are encoded at a time, up to one text more.
SLICE = 1_000_000
#: Buckets that a passage's four-byte strings fall into, to see how many differ.
BUCKETS = 1024


def _classes() -> np.ndarray:
    """Class of each byte: vowels, other lower-case letters, capitals, digits, white space, the bytes of longer
    characters; every other printable ASCII character is its own class."""
    found = np.zeros(256, np.int64)
    found[[ord(x) for x in "abcdefghijklmnopqrstuvwxyz"]] = 1
    found[[ord(x) for x in "aeiou"]] = 2
    found[ord("A") : ord("Z") + 1] = 3
    found[ord("0") : ord("9") + 1] = 4
    found[32], found[10], found[9] = 5, 6, 7
    found[0x80:0xC0], found[0xC0:] = 8, 9
    marks = [i for i in range(33, 127) if not chr(i).isalnum()]
    found[marks] = 10 + np.arange(len(marks))
    return found


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_FEATURES = N_CLASSES + 3


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of every text); an empty text has one empty passage."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(counts) - counts
    begins = np.cumsum(sizes) - sizes
    passage = np.repeat(first, sizes) + (np.arange(len(data)) - np.repeat(begins, sizes)) // PASSAGE
    n = int(counts.sum())
    found = np.bincount(passage * N_CLASSES + CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    length = found.sum(1)
    features = np.zeros((n, N_FEATURES), np.float32)
    features[:, :N_CLASSES] = np.sqrt(found / np.maximum(length, 1)[:, None])
    seen = np.zeros(n * BUCKETS, np.uint8)
    if len(data) > 3:
        wide = data.astype(np.uint32)
        code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        whole = passage[3:] == passage[:-3]
        seen[passage[:-3][whole] * BUCKETS + ((code[whole] * np.uint32(0x9E3779B1)) >> np.uint32(22))] = 1
    features[:, N_CLASSES] = seen.reshape(n, BUCKETS).sum(1, dtype=np.int32) / np.maximum(length, 1)
    features[:, N_CLASSES + 1] = np.log1p(length) / 6
    features[:, N_CLASSES + 2] = np.log1p(np.repeat(counts, counts)) / 6
    return features, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.weights, np.cumsum(counts) - counts
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (v * u) @ w["g"]
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * a[:, None], starts)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "score": _sigmoid(z @ w["o"] + w["c"])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.forward(*encode_passages(texts))["score"].astype(np.float64)


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """Full-batch Adam on the labels of the bags; with one label only, every score is that label's smoothed share."""
    rng = np.random.default_rng(0)
    scale = x.std(0) + 0.02 if len(x) else np.ones(N_FEATURES)
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    share = (labels.sum() + 1) / (len(labels) + 2)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "g": draw(GATE), "o": np.zeros(HIDDEN, np.float32), "c": np.array(np.log(share / (1 - share)), np.float32)}
    model = Model(mean.astype(np.float32), scale.astype(np.float32), w)
    if len(set(labels.tolist())) < 2:
        return model
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, EPOCHS + 1):
        f = model.forward(x, counts)
        error = ((f["score"] - labels) / len(labels)).astype(np.float32)
        h, a, v, u = f["h"], f["a"], f["v"], f["u"]
        bag = np.repeat(np.arange(len(counts)), counts)
        dz = error[:, None] * w["o"]
        along = (dz[bag] * h).sum(1)
        d_logit = a * (along - (dz * f["z"]).sum(1)[bag])
        dv, du = d_logit[:, None] * w["g"] * u * (1 - v**2), d_logit[:, None] * w["g"] * v * u * (1 - u)
        dh = (a[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
        slopes = {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "g": (v * u).T @ d_logit, "o": f["z"].T @ error, "c": error.sum()}
        for k, slope in slopes.items():
            slope = slope + (DECAY * w[k] if k in ("W", "o") else 0)
            m, s = moments[k]
            m[...] = 0.9 * m + 0.1 * slope
            s[...] = 0.999 * s + 0.001 * slope**2
            w[k] = w[k] - np.float32(RATE) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            w[k] = w[k].astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null identifier isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(texts: list[bytes], labels: list[int]) -> pa.RecordBatch:
        x, counts = encode_passages(texts)
        packed_bags = [p.tobytes() for p in np.split(x, np.cumsum(counts)[:-1])]
        return pa.record_batch({"quality": pa.array(labels, pa.int32()), "features": pa.array(packed_bags, pa.binary())})

    for batch in batches:
        texts, labels, size = [], [], 0
        for x, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            texts.append((x.as_py() or "").encode())
            labels.append(label)
            size += len(texts[-1])
            if size > SLICE:
                yield made(texts, labels)
                texts, labels, size = [], [], 0
        if texts:
            yield made(texts, labels)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labels.quality (0 or 1; anything else is skipped, of several labels of a document the largest
    counts) on at most sample_docs documents that aren't held out. Of repeated documents each counts."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # of a set size, so it may be broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = slim.join(F.broadcast(sample), "doc_id").select("text", "quality").mapInArrow(_features, "quality int, features binary").collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.features)))  # in one order, whatever the tasks' order
    bags = [np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return fit(x, np.array([len(b) for b in bags], np.int64), np.array([r.quality for r in rows], np.float32))


def score_of(model: Model, text: Column) -> Column:
    """The score of each whole text, 0 to 1; null counts as empty. Only texts go to Python, and only scores come back."""

    def run(texts: pa.Array) -> pa.Array:
        scores, held, size = [], [], 0
        for x in texts:
            held.append((x.as_py() or "").encode())
            size += len(held[-1])
            if size > SLICE:
                scores.append(model.score(held))
                held, size = [], 0
        scores.append(model.score(held))
        return pa.array(np.concatenate(scores))

    return F.arrow_udf(run, "double")(text)


def with_quality(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a column of that name: the score of each whole text, 0 to 1. Null texts count as empty, which has a
    score too; a column that has the name already is replaced; repeated rows are scored each; an empty table stays empty."""
    rest = [c for c in docs.columns if c != name]
    return docs.select(*(F.col(f"`{c}`") for c in rest), score_of(model, F.col(f"`{text_col}`")).alias(name))


def keep_quality(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores `least` or more, all columns as they are, whatever their names. Null and
    empty texts are judged by the score of an empty text, repeated rows alike; an empty table stays empty."""
    return docs.filter(score_of(model, F.col(f"`{text_col}`")) >= least)


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null texts count as empty, which has a score too; repeated rows are scored each; an empty table gives an empty
    result; labels, languages, sources and identifiers are no inputs of a score."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_quality(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
