"""Conditional distributions by idf-scored tiers and a smoothed ladder.

A query is a list of items that baskets should carry and of facets that should be empty. Baskets are scored by the
idf of what they match; tiers are the baskets at or above a score. From the narrowest tier outwards, geometric steps
give a few levels; each level's counts (with entities weighted down that are too frequent in it) are smoothed with
the next wider one. Every step over baskets is a Spark aggregation; what comes to the driver is one row per combination
of matched items and per level, of which there are at most 2 ** items (or the sample's baskets) and six.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coplex.operators.predicates import has, has_any

M = 300
STOP = 10
CAP_SHARE, CAP_LEAST = 0.02, 6
WELL_TAGGED = 30
BETA = 0.8
NONE_LEAST, NONE_MOST = 0.05, 0.995

#: ("tag", tid) or ("none", tids of the facet).
Item = tuple[str, object]


@dataclass
class Level:
    cut: int
    size: int
    n: float = 0.0


@dataclass
class Tiers:
    scored: DataFrame
    levels: list[Level]
    sizes: list[int]
    m: float

    @property
    def n_tiers(self) -> int:
        return len(self.sizes)


def mask(item: Item) -> Column:
    kind, value = item
    return has(value) if kind == "tag" else ~has_any(sorted(value))


def idf(n: int, count: int) -> int:
    return round(1000 * math.log(n / max(count, 0.5)))


def step_sizes(sizes: Sequence[int], m: float) -> list[int]:
    """The first tier of 1, m/10, m/3, m, 3m and 10m baskets, each once; the widest where none is that large."""
    picks = [next((s for s in sizes if s >= least), sizes[-1]) for least in (1, m // 10, m // 3, m, 3 * m, 10 * m)]
    return list(dict.fromkeys(picks))


def _expanded(t: Tiers) -> DataFrame:
    """Each basket once for every level whose cut its score reaches."""
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(x.cut).alias("cut")) for i, x in enumerate(t.levels)))
    reached = F.transform(F.filter(levels, lambda x: x["cut"] <= F.col("score")), lambda x: x["level"])
    return t.scored.withColumn("level", F.explode(reached))


def weighted(t: Tiers) -> DataFrame:
    """Baskets by level, with weight min(1, cap / count of the entity in the level); entity 0 has weight 1."""
    rows = _expanded(t)
    cap = F.element_at(F.array(*(F.lit(max(float(CAP_LEAST), CAP_SHARE * x.size)) for x in t.levels)), F.col("level") + 1)
    per_entity = rows.filter("entity <> 0").groupBy("level", "entity").agg(F.count(F.lit(1)).alias("c")).select("level", "entity", F.least(F.lit(1.0), cap / F.col("c")).alias("w"))
    return rows.join(per_entity, ["level", "entity"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def tiers(sample: DataFrame, items: Sequence[Item], m: float = M) -> Tiers:
    """Scores a sample (pid, items, entity, n_items) and picks the levels. Items of no positive idf drop out.

    One aggregation counts the baskets of each combination of matched items, which gives counts, scores and tiers."""
    if len(items) > 62:
        raise ValueError("a query has at most 62 items")
    matched = sum((F.when(mask(x), F.lit(1 << i).cast("long")).otherwise(0) for i, x in enumerate(items)), F.lit(0).cast("long"))
    found = [(r["matched"], r["count"]) for r in sample.groupBy(matched.alias("matched")).count().collect()]
    n = sum(c for _, c in found)
    worth = [idf(n, sum(c for bits, c in found if bits >> i & 1)) for i in range(len(items))] if n else []
    score = sum((F.when(mask(x), F.lit(v)).otherwise(0) for x, v in zip(items, worth, strict=False) if v > 0), F.lit(0))
    by_score: dict[int, int] = {}
    for bits, c in found:
        key = sum(v for i, v in enumerate(worth) if v > 0 and bits >> i & 1)
        by_score[key] = by_score.get(key, 0) + c
    sizes, total = [], 0
    for key in sorted(by_score, reverse=True):
        total += by_score[key]
        sizes.append((total, key))
    cut_of = dict(sizes)
    made = Tiers(sample.withColumn("score", score.cast("int")), [Level(cut_of[s], s) for s in step_sizes([s for s, _ in sizes], m)] if sizes else [], [s for s, _ in sizes], m)
    if made.levels:
        for r in weighted(made).groupBy("level").agg(F.sum("w").alias("n")).collect():
            made.levels[r["level"]].n = r["n"]
    return made


def kept_levels(n: Sequence[float], m: float) -> int:
    """How many levels count: through the first with STOP * m baskets."""
    return next((i + 1 for i, x in enumerate(n) if x >= STOP * m), len(n))


def coefficients(n: Sequence[float], m: float, with_base: bool) -> tuple[list[float], float]:
    """The ladder as one weighted sum: p = sum of c_j * k_j, plus the second number times the base."""
    c, passed = [], 1.0
    for i, x in enumerate(n):
        last = i == len(n) - 1 and not with_base
        c.append(0.0 if last and x <= 0 else passed / (x if last else x + m))
        passed *= m / (x + m)
    return c, passed if with_base else 0.0


def ladder(t: Tiers, pool: Sequence[int], base: DataFrame | None = None) -> DataFrame:
    """(tid, n_top, k_top, p) of the pool's items; base (tid, base) is what the widest level is smoothed with."""
    n = [x.n for x in t.levels][: kept_levels([x.n for x in t.levels], t.m)]
    c, rest = coefficients(n, t.m, base is not None)
    spark = t.scored.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in pool], "tid int")
    if not n:
        p = wanted.select("tid", F.lit(0.0).alias("n_top"), F.lit(0.0).alias("k_top"), F.lit(0.0).alias("p"))
        return p if base is None else p.join(base, "tid", "left").select("tid", "n_top", "k_top", F.coalesce("base", F.lit(0.0)).alias("p"))
    coefficient = F.element_at(F.array(*map(F.lit, c)), F.col("level") + 1)
    hits = weighted(t).filter(F.col("level") < len(n)).select("level", "w", F.explode("items").alias("tid")).filter(F.col("tid").isin([int(x) for x in pool]))
    k = hits.groupBy(F.col("tid").cast("int").alias("tid")).agg(F.sum(F.when(F.col("level") == 0, F.col("w")).otherwise(0.0)).alias("k_top"), F.sum(F.col("w") * coefficient).alias("s"))
    out = wanted.join(k, "tid", "left")
    out = out.join(base, "tid", "left") if base is not None else out.withColumn("base", F.lit(0.0))
    return out.select("tid", F.lit(n[0]).alias("n_top"), F.coalesce("k_top", F.lit(0.0)).alias("k_top"), (F.coalesce("s", F.lit(0.0)) + F.lit(rest) * F.coalesce("base", F.lit(0.0))).alias("p"))


@dataclass(frozen=True)
class Ask:
    """Any item of the pool, among baskets of `well` items or more; with absent items, among baskets that have an item of
    the pool or one of these."""

    pool: tuple[int, ...]
    well: int = 0
    absent: tuple[int, ...] = ()


def any_ladders(t: Tiers, asks: Sequence[Ask], bases: Sequence[float | None] = ()) -> list[float]:
    """P(any of the pool) of each ask by the same ladder, in one aggregation. Each stops on its own counts."""
    bases = list(bases) or [None] * len(asks)
    if not t.levels:
        return [b or 0.0 for b in bases]
    sums = []
    for i, x in enumerate(asks):
        hit = has_any(list(x.pool))
        counted = (hit | has_any(list(x.absent))) if x.absent else (F.col("n_items") >= x.well)
        sums += [F.sum(F.when(hit & counted, F.col("w")).otherwise(0.0)).alias(f"a{i}"), F.sum(F.when(counted, F.col("w")).otherwise(0.0)).alias(f"n{i}")]
    by_level = {r["level"]: r for r in weighted(t).groupBy("level").agg(*sums).collect()}
    out = []
    for i, base in enumerate(bases):
        pairs = [(by_level[j][f"a{i}"], by_level[j][f"n{i}"]) if j in by_level else (0.0, 0.0) for j in range(len(t.levels))]
        pairs = pairs[: kept_levels([n for _, n in pairs], t.m)]
        c, rest = coefficients([n for _, n in pairs], t.m, base is not None)
        out.append(sum(x * a for x, (a, _) in zip(c, pairs, strict=True)) + rest * (base or 0.0))
    return out


def any_ladder(t: Tiers, pool: Sequence[int], well: int = 0, absent: Sequence[int] = (), base: float | None = None) -> float:
    return any_ladders(t, [Ask(tuple(pool), well, tuple(absent))], [base])[0]


def none_prob(t: Tiers, pool: Sequence[int], well: int = WELL_TAGGED, absent: Sequence[int] = (), prior: Tiers | None = None) -> float:
    """P(facet empty), NONE_LEAST at least; the base is the same share of the prior sample."""
    base = any_ladder(prior, pool, well, absent) if prior is not None else None
    return max(NONE_LEAST, 1 - any_ladder(t, pool, well, absent, base))


def anchor_lift(sample: DataFrame, pool: Sequence[int], rates: DataFrame, total: int, m: float = M) -> DataFrame:
    """(tid, lift): the items' smoothed share of the anchors' sample over their base rate, within [0.25, 4]; unweighted."""
    n = sample.count()
    counts = sample.select(F.explode("items").alias("tid")).filter(F.col("tid").isin(list(pool))).groupBy("tid").agg(F.count(F.lit(1)).alias("c"))
    pb = F.greatest(F.col("n") / F.lit(total), F.lit(1e-9))
    joined = rates.filter(F.col("tid").isin(list(pool))).join(counts, "tid", "left")
    share = (F.coalesce("c", F.lit(0)) + m * pb) / (n + m)
    return joined.select(F.col("tid").cast("int").alias("tid"), F.least(F.lit(4.0), F.greatest(F.lit(0.25), share / pb)).alias("lift"))


def prior_for(prior: Tiers, pool: Sequence[int], lifts: DataFrame | None = None) -> DataFrame:
    """(tid, base): the ladder on the wide sample, times the anchors' lift, 1 at most."""
    found = ladder(prior, pool).select("tid", "p")
    if lifts is None:
        return found.withColumnRenamed("p", "base")
    return found.join(lifts, "tid", "left").select("tid", F.least(F.lit(1.0), F.col("p") * F.coalesce("lift", F.lit(1.0))).alias("base"))


def candidates(found: DataFrame, rates: DataFrame, total: int, exclude: Sequence[int] = (), beta: float | None = BETA, lift_min: float = 0.0, top: int | None = 12) -> DataFrame:
    """(tid, conf, lift, k), the best `top` by conf * lift ** beta (by conf without beta); ties by tid. A top-k report."""
    pb = F.col("n") / F.lit(float(total))
    lift = F.when(pb > 0, F.col("p") / pb).otherwise(0.0)
    kept = found.join(rates.select(F.col("tid").cast("int").alias("tid"), "n"), "tid", "left").withColumn("lift", F.coalesce(lift, F.lit(0.0)))
    kept = kept.filter((F.col("p") > 0) & (F.col("lift") >= lift_min))
    if exclude:
        kept = kept.filter(~F.col("tid").isin([int(x) for x in exclude]))
    ranked = kept.orderBy(F.desc(F.col("p") * F.pow("lift", F.lit(beta or 0.0))), "tid")
    return (ranked.limit(top) if top else ranked).select("tid", F.col("p").alias("conf"), "lift", F.col("k_top").alias("k"))


def pair_share(sample: DataFrame, first: int, rest: Sequence[int], m: float = M, prior: DataFrame | None = None, well: int = WELL_TAGGED) -> float:
    """P(any of rest | first) among well-tagged baskets, smoothed once with the same share of the prior sample."""

    def counts(df: DataFrame) -> tuple[int, int]:
        r = df.filter((F.col("n_items") >= well) & has(first)).agg(F.count_if(has_any(list(rest))).alias("k"), F.count(F.lit(1)).alias("n")).first()
        return r["k"], r["n"]

    base = None
    if prior is not None:
        k, n = counts(prior)
        base = k / n if n else None
    k, n = counts(sample)
    if base is None:
        return k / n if n else 0.0
    return (k + m * base) / (n + m)


def pair_adjust(cands: list[tuple], lifts: dict[tuple[int, int], float | None], picked: Sequence[int], none_p: float, required: bool) -> tuple[list[tuple], float]:
    """Confidences of (tid, conf, ...) times the product of their lifts with what is picked, within [0.02, 20]; the
    chance of none follows their sum. Nothing changes without picked items; none_p stays where the facet is required."""
    if not picked or not cands:
        return cands, none_p
    out = []
    for tid, conf, *more in cands:
        product = math.prod(x for p in picked if (x := lifts.get((p, tid))) is not None)
        out.append((tid, conf * min(20.0, max(0.02, product)), *more))
    before, after = sum(c[1] for c in cands), sum(c[1] for c in out)
    if not required and before > 0:
        none_p = min(NONE_MOST, 1 - (1 - none_p) * min(1.0, after / before))
    return out, none_p
