"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its runs of five words (lower-cased in A-Z). Documents with equal sets form one class, whatever
their number, and one representative goes on. Its MinHash signature gives a path of DEPTH values in each of TREES prefix
tries; all paths are written once, sorted by tree and path, so a trie's nodes are runs of rows with a common prefix.
Every representative starts by looking for others in its nodes at full depth and shortens its prefixes level by level:
what shares a node is a candidate, candidates are verified exactly, and a representative whose links let it expect the
target recall (each link of similarity s stands for 1 / P(found at this depth | s) links) stops there. The others go
on to the depth at which even the least similar pairs meet the target.

Verification works on clusters of candidates, in blocks. Members are dealt by size class, as sets whose sizes differ by
more than the threshold cannot be linked, and within a class into blocks of bounded size; a block pair's intersections
are one matrix product over the shingles that two of its members share. Pairs never become rows: a block pair gives link
counts per member and a forest of its links, from which components make the classes. A cluster that a level does not
change is not verified again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, staged
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 40, 8
#: Bytes of a path's value.
VALUE = 2
#: Recall that two sets at the threshold must have; at 0.9999 the last prefixes have seven values.
TARGET_RECALL = 0.9999
#: Members of a block: a sixteenth of its cluster's size class, within these.
BLOCK = (128, 1024)
#: Rows of a block's matrix that are judged at a time, and columns of shingles that are multiplied at a time.
STRIP, COLUMNS = 256, 2048
#: Words whose hashes a task remembers.
CACHED_WORDS = 200_000

_rng = np.random.default_rng(20)
FACTORS = (_rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)).reshape(TREES, DEPTH)
SHIFTS = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32).reshape(TREES, DEPTH)
_hashes: dict[bytes, int] = {}


def recall(similarity, depth: int, trees: int = TREES):
    """Chance that two sets of that similarity share a prefix of that length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of WORDS words; of all words if there are fewer; none if none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    for x in set(words).difference(_hashes):
        _hashes[x] = xxhash.xxh3_64_intdigest(x)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    made = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        made = mix(made * np.uint64(3) + h[i : len(h) - n + 1 + i])
    return np.unique(made)


def paths(sets: list[np.ndarray]) -> list[bytes]:
    """The paths of each set, one tree's after the other: DEPTH MinHash values, hashed to VALUE bytes each."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), TREES, DEPTH), ">u2")
    for tree in range(TREES):
        for level in range(DEPTH):
            value = np.minimum.reduceat(low * FACTORS[tree, level] + SHIFTS[tree, level], starts)
            out[:, tree, level] = mix(value.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)
    return [x.tobytes() for x in out]


SIGNED = "row long, doc_id long, set_key binary, size int, paths binary"


def _key(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(at: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [x for x in sets if len(x)]
        found = iter(paths(full) if full else ())
        keys, sizes = [_key(x) for x in sets], [len(x) for x in sets]
        own = [batch.column(i).slice(at, len(sets)) for i in (0, 1)]
        return pa.record_batch({"row": own[0], "doc_id": own[1], "set_key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int32()), "paths": pa.array([next(found) if k else None for k in keys], pa.binary())})

    for batch in batches:
        held, size, at = [], 0, 0
        for x in batch.column(2):
            held.append(shingles(x.as_py()))
            size += len(held[-1])
            if size > 100_000:
                yield made(at, held)
                held, size, at = [], 0, at + len(held)
        yield made(at, held)
    _hashes.clear()
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            yield pa.record_batch({"node": part.column(0), "shingles": pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())})
    _hashes.clear()
    give_back()


def overlaps(sets: list[np.ndarray], left: int, columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all; shingles of one set only are left out."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    rank = np.cumsum(counts > 1) - 1
    owner, at = owner[shared], rank[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((left, len(sets)), np.float32)
    part = np.zeros((len(sets), columns), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, (first, first + columns))
        part[...] = 0
        part[owner[a:b], at[a:b] - first] = 1
        for strip in range(0, left, STRIP):
            out[strip : strip + STRIP] += part[strip : min(left, strip + STRIP)] @ part.T
    return out


VERIFIED = "node long, n_texts long, n_links long, expected double, root long"


def _verify(threshold: float, depth: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One block pair: rows of side 0, and of side 1 unless the block meets itself."""
        rows = rows.sort_values(["side", "node"], kind="stable")
        alone = bool(rows["alone"].iloc[0])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        node, size, weight = rows["node"].to_numpy(), np.array([len(x) for x in sets]), rows["n_docs"].to_numpy()
        left, n = int((rows["side"] == 0).sum()), len(rows)
        both = overlaps(sets, left)
        linked = np.zeros((left, n), bool)
        texts, docs, expected = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for at in range(0, left, STRIP):
            stop = min(left, at + STRIP)
            similarity = both[at:stop] / np.maximum(size[at:stop, None] + size[None, :] - both[at:stop], 1).astype(np.float64)
            found = similarity >= threshold
            if alone:
                found[np.arange(stop - at), np.arange(at, stop)] = False
            else:
                found[:, :left] = False
            linked[at:stop] = found
            inverse = np.zeros(found.shape)
            inverse[found] = 1 / recall(similarity[found], depth)
            texts[at:stop] += found.sum(1)
            docs[at:stop] += found @ weight
            expected[at:stop] += inverse.sum(1)
            if not alone:
                texts += found.sum(0)
                docs += found.T @ weight[at:stop]
                expected += inverse.sum(0)
        # a forest of the links: every member points to the smallest of its part of the graph
        part = np.arange(n)
        while True:
            new = part.copy()
            for at in range(0, left, STRIP):
                own = linked[at : at + STRIP]
                stop = at + len(own)
                np.minimum(new[at:stop], np.where(own, part[None, :], n).min(1, initial=n), out=new[at:stop])
                np.minimum(new, np.where(own, new[at:stop, None], n).min(0, initial=n), out=new)
            new = new[new]
            if (new == part).all():
                break
            part = new
        if n > BLOCK[0]:
            del both, linked, sets
            give_back()
        return pd.DataFrame({"node": node, "n_texts": texts, "n_links": docs, "expected": expected, "root": node[part]})

    return run


def _verified(cluster: DataFrame, sets: DataFrame, keyed: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Rows of VERIFIED for every block pair of the clusters (node, component)."""
    low, high = BLOCK
    member = cluster.join(sets.select("node", "n_docs", "size"), "node").withColumn("class", F.floor(F.log("size") / math.log(1 / threshold)).cast("int") if threshold < 1 else F.lit(0))
    member = staged(member, "classed")  # written, as what follows, so that the joins can split a large component
    sized = member.groupBy("component", "class").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / F.least(F.greatest(F.ceil(F.col("m") / 16), F.lit(low)), F.lit(high))).cast("int")
    # a component has some dozens of size classes at most
    dealt = staged(sized.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("class", blocks.alias("blocks")))).alias("blocks")), "blocks")
    member = member.join(dealt, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("class")]).cast("int"))
    own, block = F.col("class"), F.col("block")

    def pair(lo, hi, i, j, side, alone):
        return F.struct(lo.alias("lo"), hi.alias("hi"), i.alias("i"), j.alias("j"), side.alias("side"), alone.alias("alone"))

    def along(other, made):
        n = F.try_element_at("blocks", other)
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), made)

    same = along(own, lambda k: pair(own, own, F.least(k, block), F.greatest(k, block), F.when(block <= k, 0).otherwise(1), k == block))
    above = along(own + 1, lambda k: pair(own, own + 1, block, k, F.lit(0), F.lit(False)))
    below = along(own - 1, lambda k: pair(own - 1, own, k, block, F.lit(1), F.lit(False)))
    texts = keyed.join(member.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi").select("row", "text").mapInArrow(_sets, "node long, shingles binary")
    rows = staged(member, "members").join(texts, "node").select("component", "node", "n_docs", "shingles", F.explode(F.concat(same, above, below)).alias("p")).select("component", "node", "n_docs", "shingles", "p.*")
    return rows.groupBy("component", "lo", "hi", "i", "j").applyInPandas(_verify(threshold, depth), VERIFIED)


def classes(keyed: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(row, doc_id, class, class_id, n_links, n_text_links) for rows (row, doc_id, text); class is a row number too.

    keyed must give the same rows whenever it is read."""
    signed = staged(keyed.select("row", "doc_id", "text").mapInArrow(_sign, SIGNED), "signed")
    by_set = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_docs"), F.first("size").alias("size"))
    sets = staged(by_set, "sets")
    chosen = signed.join(sets.select(F.col("node").alias("row")), "row", "left_semi")
    width = DEPTH * VALUE
    at = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    trie = chosen.select("row", "paths", at).select(F.col("tree").cast("byte").alias("tree"), F.substring(F.col("paths"), F.col("tree") * width + 1, F.lit(width)).alias("path"), "row")
    trie = staged(trie.repartitionByRange("tree", "path", "row").sortWithinPartitions("tree", "path", "row"), "trie")
    cluster, counts, forest, active = None, None, None, trie
    for depth in range(DEPTH, 0, -1):
        prefix = F.substring(F.col("path"), 1, depth * VALUE).alias("prefix")
        # nodes that hold several, one of which at least still looks; written, so that the join can split hot ones
        nodes = trie.groupBy("tree", prefix).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1").drop("n")
        if active is not trie:
            nodes = nodes.join(active.select("tree", prefix).distinct(), ["tree", "prefix"], "left_semi")
        nodes = staged(nodes, "nodes")
        edges = trie.select("tree", prefix, "row").join(nodes, ["tree", "prefix"]).filter("row > first").select(F.col("row").alias("a"), F.col("first").alias("b"))
        before = cluster
        if before is not None:
            edges = edges.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        cluster = staged(components(edges), "clusters")
        new = cluster
        if before is not None:
            old = F.coalesce("old", F.col("node"))
            grown = cluster.join(before.select("node", F.col("component").alias("old")), "node", "left").groupBy("component").agg(F.min(old).alias("x"), F.max(old).alias("y")).filter("x <> y").select("component")
            new = cluster.join(grown, "component", "left_semi")
        verified = staged(_verified(new, sets, keyed, threshold, depth), "verified")
        found = verified.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"), F.sum("expected").alias("expected"))
        links = verified.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        # a cluster that grew was verified as a whole, so its counts replace older ones
        counts = staged(found if counts is None else counts.join(found.select("node"), "node", "left_anti").unionByName(found), "counts")
        forest = links if forest is None else forest.union(links)
        if recall(threshold, depth) >= target_recall:
            break
        settled = counts.filter((F.col("n_texts") > 0) & (F.col("n_texts") >= target_recall * F.col("expected"))).select(F.col("node").alias("row"))
        active = trie.join(settled, "row", "left_anti")
    joined = staged(components(forest), "joined").join(sets.select("node", "least_id"), "node")
    named = joined.join(joined.groupBy("component").agg(F.min("least_id").alias("class_id")), "component").select("node", F.col("component").alias("class"), "class_id")
    known = sets.join(counts, "node", "left").join(named, "node", "left").select(
        "set_key", F.coalesce("class", "node").alias("class"), F.coalesce("class_id", "least_id").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links")
    )
    # written, so that the join can split a set with many copies; rows without words have no set to join by
    known = staged(known, "known")
    full = signed.filter("set_key IS NOT NULL").join(known, "set_key").select("row", "doc_id", "class", "class_id", "n_links", "n_text_links")
    none = F.lit(0).cast("long")
    return full.union(signed.filter("set_key IS NULL").select("row", "doc_id", F.col("row").alias("class"), F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_text_links")))


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_text_links.

    n_links counts the other documents whose sets have a Jaccard similarity of the threshold or more, copies
    included; n_text_links counts the different sets among them. class_id is the smallest doc_id that a document is
    connected with over such links. A text of one to four words has one shingle, of all its words; null and empty
    texts have none and are linked with nothing. Rows without an identifier take part, as higher than any other.
    Repeated rows are copies of each other. An empty table gives an empty result; other columns are not read."""
    keyed = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "keyed")
    return classes(keyed, threshold, target_recall).select("doc_id", "class_id", "n_links", "n_text_links")


def keep_one_of_class(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns as they are, whatever their names.

    The row of the smallest identifier stays; a null identifier is higher than any other, and of rows alike in that, the
    first in the table's order stays. Rows whose text is null, empty or white space are linked with nothing and all
    stay. Rows are told apart by their place, so rows of one identifier with other texts are judged by themselves. An
    empty table stays empty."""
    stored = staged(docs.select(packed(docs), F.monotonically_increasing_id().alias("row")), "documents")
    keyed = stored.select("row", F.col("doc").getField(id_col).cast("long").alias("doc_id"), F.col("doc").getField(text_col).alias("text"))
    best = classes(keyed, threshold).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    # what stays grows with the table, so it is joined in the same way at every size
    return stored.join(staged(best.select("best.row"), "kept").hint("merge"), "row", "left_semi").select("doc.*")
