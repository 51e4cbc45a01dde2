"""Hard negatives by threshold joins over pruned inverted indexes.

Rows are dealt into blocks, anchors into groups, and every group meets every block once: each group of anchors is a stated
query set against all rows, in blocks. Inside, a threshold join finds all rows that score at or above each anchor's threshold.
Dimensions are ordered by energy and cut into strips. A row's last strips aren't indexed where the norm of that suffix, times
the largest anchor's norm, stays below the threshold, as no row could reach it by them alone. Partial scores accumulate strip
after strip over the rows that have it indexed; what can't reach the threshold even by the product of both remaining norms is
pruned, and what is left is finished on the row's own vector. Where a window isn't full, its anchor's threshold is lowered
and it is asked again, down to the window's floor, so results are exact.

Scores are integers in double precision, exact below 2 ** 53."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's.
FLOOR, CEILING = 50, 95
#: Dimensions of a strip; share of pairs from which on the rest are held one by one.
STRIP, SPARSE = 8, 0.125
#: Rows of a block and anchors of a group at most, so that a task's arrays are bounded; rows a block has at least.
MOST, LEAST = 32_768, 1024
#: Anchors and rows that are scored at a time.
TILE = 512, 4096


def above(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose inner product is least[anchor] or more."""
    strips = [slice(c, c + STRIP) for c in range(0, q.shape[1], STRIP)]
    suffix = lambda v: np.sqrt(np.stack([(v[:, s.start :] ** 2).sum(axis=1) for s in strips] + [np.zeros(len(v))]))
    qn, xn = suffix(q), suffix(x)
    slack = 1 - 1e-9
    bound = least - 1.0  # room for rounding of the norms, as scores are whole
    # the index: a row has its first strips, until the rest of it can't reach the least threshold
    depth = np.minimum((xn * qn[0].max(initial=0) >= slack * bound.min(initial=np.inf)).sum(axis=0), len(strips))
    if bound.min(initial=np.inf) <= 0:
        depth[:] = len(strips)
    order = np.argsort(-depth, kind="stable")
    x, xn, depth = x[order], xn[:, order], depth[order]
    indexed = [int((depth > c).sum()) for c in range(len(strips))] or [0]
    m = indexed[0] if strips else len(x)
    scores = np.zeros((len(q), m))
    rows, alive = np.arange(m), np.ones(scores.shape, bool)
    c = 0
    while c < len(strips):
        scores[:, : indexed[c]] += q[:, strips[c]] @ x[: indexed[c], strips[c]].T
        c += 1
        met = np.minimum(c, depth[:m])  # strips of the row that the score holds
        if 2 * c >= len(strips):
            alive = scores + qn[met].T * xn[met, rows] >= slack * bound[:, None]
            if not alive.size or alive.mean() < SPARSE:
                break
    a, r = np.nonzero(alive)
    s, met = scores[a, r], np.minimum(c, depth[r])
    for k in range(int(met.min(initial=len(strips))), len(strips)):
        own = met <= k  # indexed rows at strip k, and what of the others isn't indexed
        s = s + np.where(own, np.einsum("ij,ij->i", q[a, strips[k]], x[r, strips[k]]), 0.0)
        rest = np.maximum(met, k + 1)
        stays = s + qn[rest, a] * xn[rest, r] >= slack * bound[a]
        a, r, s, met = a[stays], r[stays], s[stays], met[stays]
    good = s >= least[a]
    return a[good], order[r[good]], s[good]


def tiles(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """above() by tiles of bounded size."""
    energy = np.argsort(-(x**2).sum(axis=0), kind="stable") if len(x) else np.arange(q.shape[1])
    q, x, found = q[:, energy], x[:, energy], []
    for i in range(0, len(q), TILE[0]):
        for j in range(0, len(x), TILE[1]):
            a, r, s = above(q[i : i + TILE[0]], x[j : j + TILE[1]], least[i : i + TILE[0]])
            found.append((a + i, r + j, s))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def first(keys: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted keys' entries are among the first k of their key."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) < k


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each vector, shorter ones filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Side:
    """The rows or anchors of one task."""

    def __init__(self, table: pa.Table, width: int):
        t = table.combine_chunks()
        vectors = t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
        self.ids, self.labels, self.x = t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(vectors, width)
        self.table = t

    @staticmethod
    def width(*tables: pa.Table) -> int:
        return max([0, *(int(n) for t in tables if t.num_rows for n in np.diff(t.column("v").combine_chunks().offsets.to_numpy()))])

    def once(self) -> Side:
        """Without all but the first row of an identifier, by label and vector."""
        order = np.lexsort((*self.x.T[::-1], self.labels, self.ids))
        ids = self.ids[order]
        keep = order[np.append(True, ids[1:] != ids[:-1])] if len(ids) else order
        self.ids, self.labels, self.x = self.ids[keep], self.labels[keep], self.x[keep]
        return self


def _lowered(anchors: np.ndarray, q: np.ndarray, x: np.ndarray, start: np.ndarray, floor: np.ndarray, judge: Callable) -> list[np.ndarray]:
    """Threshold joins with ever lower thresholds. judge(anchors, rows, scores) gives columns of what to keep, anchors first, and
    the anchors that need no more; what an anchor gets counts in its last turn alone. anchors: their numbers, in order."""
    left, least, kept = np.arange(len(q)), np.maximum(start, floor), []
    for turn in range(5):
        if not len(left):
            break
        a, r, s = tiles(q[left], x, least[left])
        columns, full = judge(anchors[left[a]], r, s)
        done = np.isin(anchors[left], full) | (least[left] <= floor[left])
        of = np.isin(columns[0], anchors[left[done]])
        kept.append([c[of] for c in columns])
        left = left[~done]
        least[left] = floor[left] if turn == 3 else np.ceil((least[left] + floor[left]) / 2)
    return [np.concatenate(c) for c in zip(*kept, strict=True)]


def positives_in(anchors: Side, rows: Side, k: int) -> list[list[np.ndarray]]:
    """[anchor, row, score]: each anchor's best k rows of its label and another identifier in the block."""
    out = []
    for label in np.unique(anchors.labels):
        mine, same = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        if not len(same):
            continue
        q, x = anchors.x[mine], rows.x[same]
        reach = np.floor(np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max()))

        def judge(a: np.ndarray, r: np.ndarray, s: np.ndarray, same: np.ndarray = same):
            r = same[r]
            other = anchors.ids[a] != rows.ids[r]
            a, r, s = a[other], r[other], s[other]
            order = np.lexsort((rows.ids[r], -s, a))
            best = order[first(a[order], k)]
            return [a[best], r[best], s[best]], np.flatnonzero(np.bincount(a[best], minlength=len(anchors.ids)) >= k)

        out.append(_lowered(mine, q, x, np.floor(reach / 2), -reach - 1, judge))
    return out


def negatives_in(anchors: Side, rows: Side, lows: np.ndarray, highs: np.ndarray, k: int) -> list[np.ndarray]:
    """[anchor, window, row, score]: of each anchor's windows (lows, highs; empty where low is above high) the best k rows of
    another label in the block."""
    real = lows <= highs
    mine = np.flatnonzero(real.any(axis=1))
    floor = np.where(real, lows, np.inf).min(axis=1, initial=np.inf)[mine]
    start = np.where(real, highs, np.inf).min(axis=1, initial=np.inf)[mine]

    def judge(a: np.ndarray, r: np.ndarray, s: np.ndarray):
        other = anchors.labels[a] != rows.labels[r]
        a, r, s = a[other], r[other], s[other]
        order = np.lexsort((rows.ids[r], -s, a))
        a, r, s = a[order], r[order], s[order]
        columns, full = [], np.ones(len(anchors.ids), bool)
        for w in range(lows.shape[1]):
            inside = np.flatnonzero((s >= lows[a, w]) & (s <= highs[a, w]))
            best = inside[first(a[inside], k)]
            full &= (np.bincount(a[best], minlength=len(anchors.ids)) >= k) | ~real[:, w]
            columns.append([a[best], np.full(len(best), w), r[best], s[best]])
        return [np.concatenate(c) for c in zip(*columns, strict=True)], np.flatnonzero(full)

    return _lowered(mine, anchors.x[mine], rows.x, np.floor(start - 0.1 * (start - floor)), floor, judge) or [np.zeros(0, np.int64)] * 4


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, of: Callable, schema: str) -> DataFrame:
    """of(anchors, rows) for every group of anchors with every block of rows."""
    group = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = rows.withColumn("block", group(blocks)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = anchors.withColumn("group", group(groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(of, schema)


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, v) of the rows that take part: no null in id, label or vector, every component finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.when(v.isNotNull() & ~bad, whole).alias("v")).dropna()


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, ceiling: int = CEILING,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the column id. Components become floor(scale * x), scores are inner products, higher first, ties
    by smaller id. An anchor's positives are its best rows of its label; for each, the best rows of other labels follow whose
    score is within floor and ceiling percent of the positive's.

    Rows with a null id, label, vector or component, or with one that isn't finite, take no part; shorter vectors count as
    filled with zeros. Of rows that share an id, the first by label and vector takes part. An anchor without another row of
    its label, or without a row in its windows, gives no rows; neither does an empty table. Other columns are not read."""
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    clean = staged(usable(rows, id_col, vector_col, label, scale), "vectors")
    n = clean.count()
    anchors = staged(clean.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "anchors")
    blocks = max(1, -(-n // MOST), min(shuffle_partitions(spark), -(-n // LEAST)))
    groups = max(1, -(-anchors.count() // MOST))

    def positive(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        width = Side.width(a, b)
        mine, block = Side(a, width), Side(b, width).once()
        found = positives_in(mine, block, positives)
        x, r, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor_id": _long(mine.ids[x]), "positive_id": _long(block.ids[r]), "positive_score": _long(s)})

    near = _met(anchors, clean, blocks, groups, positive, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)  # of `positives` for each block
    listed = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    asked = staged(anchors.join(listed.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", F.transform("p", lambda x: x["positive_id"]).alias("ids"), F.transform("p", lambda x: x["positive_score"]).alias("scores")), "windows")

    def negative(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        width = Side.width(a, b)
        mine, block = Side(a, width), Side(b, width).once()
        of = [np.array(x, np.int64) for x in mine.table.column("ids").to_pylist()]
        scores = _matrix(mine.table.column("scores").combine_chunks(), positives) if len(of) else np.zeros((0, positives))
        there = np.arange(positives) < np.array([len(x) for x in of], np.int64).reshape(-1, 1)
        lows = np.where(there, np.ceil(floor * scores / 100), 1)
        highs = np.where(there, np.floor(ceiling * scores / 100), 0)
        x, w, r, s = negatives_in(mine, block, lows, highs, negatives)
        ids = np.array([of[i][j] for i, j in zip(x.tolist(), w.tolist(), strict=True)], np.int64)
        return pa.table({"anchor_id": _long(mine.ids[x]), "positive_id": _long(ids), "place": _long(w), "positive_score": _long(scores[x, w]), "negative_id": _long(block.ids[r]), "negative_score": _long(s)})

    found = _met(asked, clean, blocks, groups, negative, "anchor_id long, positive_id long, place long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
