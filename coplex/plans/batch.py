"""Conditional distributions for a table of questions at once: tiers, levels, ladders and candidates in one plan.

A question is a row of QUESTIONS: which sample of baskets it looks at and which wide sample smooths it (if any); which items
baskets should carry and which facets should be empty; whose shares are asked for. A sample is a bounded set of baskets with
its name in each.

Baskets meet their sample's questions once. What is left of a basket is which of the question's items it matches, its entity
and the measures it counts for (itself, each pool item it has, each ask it counts for and hits); counts by these four are all
that the rest works on. Scores are sums over the matches; tiers are running sizes by score; a match belongs to the narrowest
level that it reaches, and what a level counts is the sum over itself and all narrower ones, so no basket is repeated for
every level. Entities weigh less in a level that they fill, and the ladder folds the levels from the widest in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coplex.sources.store import staged

M = 300
STOP = 10
CAP_SHARE, CAP_LEAST = 0.02, 6
WELL_TAGGED = 30
BETA = 0.8
NONE_LEAST, NONE_MOST = 0.05, 0.995
#: Most items of a question, as its matches are the bits of one number.
MOST_ITEMS = 62
#: Items that a basket should have any of (tag) or none of (not tag).
ITEMS = "array<struct<tag: boolean, keys: array<smallint>>>"
#: Asks: any item of the pool, among baskets of `well` items or more; with absent items, among baskets that have an item of the
#: pool or one of these.
ASKS = "array<struct<pool: array<smallint>, well: int, absent: array<smallint>>>"
QUESTIONS = f"qid string, sample string, prior string, items {ITEMS}, pool array<smallint>, gone array<smallint>, asks {ASKS}"
#: Measures that are no items: the basket itself; then -2 - 2i where a basket counts for ask i, and -3 - 2i where it hits it.
BASKET = -1
LEVELS = 6


def inlined(query: str, **steps: str) -> str:
    """A query with its steps in place of their <names>, each of which may use those before it. Spark can't join a plan that has common
    table expressions with itself."""
    done: dict[str, str] = {}
    for name, body in (*steps.items(), ("", query)):
        for k, v in done.items():
            body = body.replace(f"<{k}>", f"({v})")
        done[name] = body
    return done[""]


def leasts(m: float) -> tuple[float, ...]:
    """Sizes whose first tiers are the levels."""
    return 1, m // 10, m // 3, m, 3 * m, 10 * m


def sided(questions: DataFrame) -> DataFrame:
    """Every question on its sample (side 0), and on the sample that smooths it (side 1) if it names one."""
    return questions.sparkSession.sql("SELECT *, 0 AS side FROM {q} UNION ALL SELECT qid, prior AS sample, * EXCEPT (qid, sample), 1 FROM {q} WHERE prior IS NOT NULL", q=questions.select("qid", "sample", "prior", "items", "pool", "asks"))


def matches(questions: DataFrame, baskets: DataFrame) -> DataFrame:
    """(qid, side, bits, entity, measure, n). baskets: (sample, items, entity, n_items)."""
    return questions.sparkSession.sql(
        """
        SELECT qid, side, bits, entity, measure, count(*) AS n FROM (
            SELECT qid, side, entity,
                   aggregate(transform(q.items, (x, i) -> IF(arrays_overlap(b.items, x.keys) = x.tag, shiftleft(1L, i), 0L)), 0L, (a, x) -> a + x) AS bits,
                   explode(concat(array(-1), CAST(array_intersect(b.items, pool) AS array<int>), flatten(transform(asks, (x, i) -> CASE
                       WHEN arrays_overlap(b.items, x.pool) AND (size(x.absent) > 0 OR n_items >= x.well) THEN array(-2 - 2 * i, -3 - 2 * i)
                       WHEN IF(size(x.absent) > 0, arrays_overlap(b.items, x.absent), n_items >= x.well) THEN array(-2 - 2 * i)
                       ELSE array() END)))) AS measure
            FROM {baskets} b JOIN {questions} q ON b.sample = q.sample)
        GROUP BY qid, side, bits, entity, measure""",
        baskets=baskets, questions=questions,
    )


def tiers(found: DataFrame) -> DataFrame:
    """(qid, side, score, n, size, combos): size counts the baskets at or above the score, combos are the matches that have it. The score
    is the sum of the idf of what is matched, where that is positive."""
    spark = found.sparkSession
    combos = found.filter(F.col("measure") == BASKET).groupBy("qid", "side", "bits").agg(F.sum("n").alias("n")).repartition("qid")
    return spark.sql(
        inlined(
            f"""SELECT *, sum(n) OVER (PARTITION BY qid, side ORDER BY score DESC) AS size FROM <tier> tier""",
            place=f"""SELECT qid, side, place, sum(n) AS c FROM {{combos}} LATERAL VIEW explode(filter(sequence(-1, {MOST_ITEMS - 1}), i -> i < 0 OR getbit(bits, greatest(i, 0)) = 1)) AS place
            GROUP BY qid, side, place""",
            idf=f"""SELECT *, CAST(bround(1000 * ln(max(IF(place < 0, c, NULL)) OVER (PARTITION BY qid, side) / c)) AS INT) AS idf FROM <place> place""",
            worth=f"""SELECT qid, side, collect_list(IF(idf > 0, struct(place, idf), NULL)) AS worth FROM <idf> idf GROUP BY qid, side""",
            scored=f"""SELECT qid, side, bits, n, aggregate(worth, 0, (a, x) -> a + IF(getbit(bits, x.place) = 1, x.idf, 0)) AS score FROM {{combos}} JOIN <worth> worth USING (qid, side)""",
            tier=f"""SELECT qid, side, score, sum(n) AS n, collect_list(bits) AS combos FROM <scored> scored GROUP BY qid, side, score""",
        ),
        combos=combos,
    )


def levels(tier: DataFrame, m: float = M) -> DataFrame:
    """(qid, side, levels array<struct<size, score>>, n_tiers, bits, level): of each question the first tier of each of the sizes, once;
    the widest where none is that large. A row for each combination of matches: the narrowest level that it reaches."""
    picks = ", ".join(f"coalesce(min(IF(size >= {x}, struct(size, score), NULL)), max(struct(size, score)))" for x in leasts(m))
    return tier.sparkSession.sql(
        inlined(
            f"""SELECT qid, side, levels, n_tiers, bits, level FROM <reached> reached LATERAL VIEW explode(combos) AS bits WHERE level >= 0""",
            one=f"""SELECT qid, side, array_sort(array_distinct(array({picks}))) AS levels, int(count(*)) AS n_tiers, collect_list(struct(score, combos)) AS tiers FROM {{tier}} GROUP BY qid, side""",
            reached=f"""SELECT qid, side, levels, n_tiers, t.combos, array_position(transform(levels, x -> x.score <= t.score), true) - 1 AS level FROM <one> one LATERAL VIEW explode(tiers) AS t""",
        ),
        tier=tier,
    )


def weighted(found: DataFrame, plan: DataFrame) -> DataFrame:
    """(qid, side, measure, k array<double>, n_tiers): weighted counts of each level. An entity's baskets weigh cap / count in a level
    where it has more than the cap; entity 0 is never capped."""
    spark = found.sparkSession
    own = found.join(plan, ["qid", "side", "bits"]).select("qid", "side", "entity", "measure", "n", "levels", "n_tiers", "level")
    counts = ", ".join(f"sum(IF(level <= {j}, n, 0L)) AS c{j}" for j in range(LEVELS))
    weights = ", ".join(f"IF(c{j} > 0, c{j} * IF(entity = 0, 1D, least(1D, greatest({CAP_LEAST}D, {CAP_SHARE}D * get(levels, {j}).size) / max(IF(measure = {BASKET}, c{j}, NULL)) OVER (PARTITION BY qid, side, entity))), 0D) AS k{j}" for j in range(LEVELS))
    sums = ", ".join(f"sum(k{j})" for j in range(LEVELS))
    return spark.sql(
        inlined(
            f"""SELECT qid, side, measure, slice(array({sums}), 1, first(size(levels))) AS k, first(n_tiers) AS n_tiers FROM <w> w GROUP BY qid, side, measure""",
            each=f"""SELECT qid, side, entity, measure, first(levels) AS levels, first(n_tiers) AS n_tiers, {counts} FROM {{own}} GROUP BY qid, side, entity, measure""",
            w=f"""SELECT qid, side, measure, levels, n_tiers, {weights} FROM <each> each""",
        ),
        own=own.repartition("qid", "entity"),
    )


def fold(k: str, n: str, base: str, m: float) -> str:
    """The ladder: shares from the widest level that counts to the narrowest, each smoothed by the one before. Levels count through
    the first with STOP * m baskets. The base if there is no level."""
    kept = f"coalesce(nullif(int(array_position(transform({n}, y -> y >= {STOP * m}D), true)), 0), size({n}))"
    step = f"(p, y) -> CASE WHEN p IS NULL THEN IF(y.n > 0, y.k / y.n, 0D) ELSE (y.k + {m}D * p) / (y.n + {m}D) END"
    return f"coalesce(aggregate(reverse(slice(zip_with(coalesce({k}, transform({n}, y -> 0D)), {n}, (a, b) -> struct(a AS k, b AS n)), 1, {kept})), double({base}), {step}), double({base}))"


def shares(questions: DataFrame, sums: DataFrame, rates: DataFrame, m: float = M, lifts: DataFrame | None = None) -> DataFrame:
    """Per question: qid, gone, n and n_tiers of its sample, items array<struct<tid, p, k, rate>> of its pool, asks array<double>, the
    share of each ask. lifts (sample, tid, lift): of the anchors, which what smooths a sample is multiplied by, to 1 at most."""
    spark = questions.sparkSession
    lifts = spark.createDataFrame([], "sample string, tid int, lift double") if lifts is None else lifts
    rows = spark.sql(
        inlined(
            """SELECT qid, measure, IF(side = 0, k, NULL) AS own, IF(side = 1, k, NULL) AS wide, IF(side = 0, n_tiers, NULL) AS n_tiers, NULL AS rate, NULL AS lift FROM {sums}
        UNION ALL SELECT qid, pool.tid, NULL, NULL, NULL, r.n, l.lift FROM <pool> pool LEFT JOIN {rates} r ON pool.tid = r.tid LEFT JOIN {lifts} l ON pool.tid = l.tid AND pool.sample = l.sample
        UNION ALL SELECT qid, -1, NULL, NULL, NULL, NULL, NULL FROM {questions}""",
            pool="""SELECT qid, sample, explode(CAST(pool AS array<int>)) AS tid FROM {questions}""",
        ),
        questions=questions, sums=sums, rates=rates, lifts=lifts,
    )
    item = fold("x.own", "n", f"IF(z IS NULL, NULL, least(1D, {fold('x.wide', 'z', 'NULL', m)} * coalesce(x.lift, 1D)))", m)
    ask = fold("others[-3 - 2 * i].own", "n_of", fold("others[-3 - 2 * i].wide", "z_of", "NULL", m), m)
    for side, name in (("own", "n_of"), ("wide", "z_of")):
        ask = ask.replace(name, f"coalesce(others[-2 - 2 * i].{side}, transform({'n' if side == 'own' else 'z'}, y -> 0D))")
    return spark.sql(
        inlined(
            f"""SELECT qid, gone, coalesce(get(n, 0), 0D) AS n, coalesce(n_tiers, 0) AS n_tiers,
               transform(p.items, x -> struct(x.tid, coalesce({item}, 0D) AS p, coalesce(get(x.own, 0), 0D) AS k, x.rate)) AS items,
               transform(asks, (x, i) -> coalesce({ask}, 0D)) AS asks
        FROM <packed> p JOIN {{questions}} q USING (qid)""",
            one=f"""SELECT qid, measure, max(own) AS own, max(wide) AS wide, max(n_tiers) AS n_tiers, max(rate) AS rate, max(lift) AS lift FROM {{rows}} GROUP BY qid, measure""",
            packed=f"""SELECT qid, max(IF(measure = -1, own, NULL)) AS n, max(IF(measure = -1, wide, NULL)) AS z, max(n_tiers) AS n_tiers,
                   collect_list(IF(measure >= 0, struct(measure AS tid, own, wide, rate, lift), NULL)) AS items, map_from_entries(collect_list(IF(measure < -1, struct(measure, struct(own, wide)), NULL))) AS others
            FROM <one> one GROUP BY qid""",
        ),
        rows=rows.repartition("qid"), questions=questions.select("qid", "gone", "asks"),
    )


def candidates(found: DataFrame, total: int, beta: float | None = BETA, lift_min: float = 0.0, top: int | None = 12) -> DataFrame:
    """What shares() gives, with cands array<struct<tid, conf, lift, k>> for items: the best `top` by conf * lift ** beta (by conf without
    beta), ties by tid, without those gone. A top-k report."""
    lifted = f"transform(items, x -> struct(x.tid, x.p AS conf, coalesce(IF(x.rate > 0, x.p / (x.rate / {float(total)}D), 0D), 0D) AS lift, x.k))"
    kept = f"filter({lifted}, x -> x.conf > 0 AND x.lift >= {lift_min}D AND NOT array_contains(gone, smallint(x.tid)))"
    ranked = f"array_sort(transform({kept}, x -> struct(-(x.conf * pow(x.lift, {beta or 0.0}D)) AS s, x.tid, x.conf, x.lift, x.k)))"
    ranked = f"slice({ranked}, 1, {top})" if top else ranked
    return found.select("*", F.expr(f"transform({ranked}, x -> struct(x.tid, x.conf, x.lift, x.k))").alias("cands")).drop("items", "gone")


def _kept(df: DataFrame) -> DataFrame:
    return staged(df, "counts")


def answered(questions: DataFrame, baskets: DataFrame, rates: DataFrame, total: int, m: float = M, lifts: DataFrame | None = None, beta: float | None = None, top: int | None = 12, own_well: int | None = None, keep: Callable[[DataFrame], DataFrame] = _kept) -> DataFrame:
    """(qid, n, n_tiers, asks, cands) of each question. With own_well, questions have no asks and get one in a second turn over the
    same levels: any of their candidates, among baskets of so many items; without candidates its share is 0.

    keep: writes the counts, which are used more than once, and reads them again."""
    both = sided(questions)
    found = keep(matches(both, baskets))
    plan = keep(levels(tiers(found), m))
    out = candidates(shares(questions, weighted(found, plan), rates, m, lifts), total, beta, 0.0, top)
    if own_well is None:
        return out
    out, none = keep(out.drop("asks")), "CAST(array() AS array<smallint>)"
    ask = f"array(struct(CAST(transform(cands, x -> x.tid) AS array<smallint>) AS pool, {own_well} AS well, {none} AS absent))"
    again = out.select("qid", "cands").join(questions.drop("asks", "pool"), "qid").selectExpr("qid", "sample", "prior", "items", f"{none} AS pool", "gone", f"{ask} AS asks")
    later = shares(again, weighted(matches(sided(again), baskets), plan), rates, m)
    return out.join(later.select("qid", "asks"), "qid")


def exact_counts(questions: DataFrame, baskets: DataFrame) -> DataFrame:
    """(qid, n, tid, c): weighted counts of the best tier and of the pool's items in it; of a question without items the counts of the
    whole sample, without weights."""
    sides = sided(questions.withColumn("prior", F.lit(None).cast("string")))
    found = _kept(matches(sides, baskets))
    best = weighted(found, levels(tiers(found))).selectExpr("qid", "measure", "get(k, 0) AS c")
    plain = found.groupBy("qid", "measure").agg(F.sum("n").cast("double").alias("plain"))
    every = plain.join(questions.selectExpr("qid", "size(items) = 0 AS free"), "qid").join(best, ["qid", "measure"], "left")
    counts = every.selectExpr("qid", "measure", "IF(free, plain, coalesce(c, 0D)) AS c").filter("c > 0")
    n = counts.filter(F.col("measure") == BASKET).selectExpr("qid", "round(c) AS n")
    return counts.filter("measure >= 0").join(n, "qid").selectExpr("qid", "n", "measure AS tid", "c")


def anchor_lifts(sample: DataFrame, rates: DataFrame, total: int, m: float = M) -> DataFrame:
    """(sample, tid, lift) of every item: its smoothed share of a sample over its base rate, within [0.25, 4]; unweighted."""
    return sample.sparkSession.sql(
        inlined(
            f"""SELECT e.sample, int(e.tid) AS tid, least(4D, greatest(0.25D, ((coalesce(c, 0) + {m}D * pb) / (size + {m}D)) / pb)) AS lift
        FROM <every> e LEFT JOIN <seen> s ON e.sample = s.sample AND e.tid = s.tid""",
            size=f"""SELECT sample, count(*) AS size FROM {{sample}} GROUP BY sample""",
            seen=f"""SELECT sample, tid, count(*) AS c FROM (SELECT sample, explode(CAST(items AS array<int>)) AS tid FROM {{sample}}) GROUP BY sample, tid""",
            every=f"""SELECT sample, size, tid, greatest(n / {float(total)}D, 1e-9D) AS pb FROM <size> size JOIN {{rates}} r ON size.sample IS NOT NULL""",
        ),
        sample=sample, rates=rates,
    )


def pair_shares(asked: DataFrame, baskets: DataFrame, m: float = M, well: int = WELL_TAGGED) -> DataFrame:
    """asked (qid, sample, prior, first, rest) with p: P(any of rest | first) among well-tagged baskets of the sample, smoothed once
    with the same share of the prior sample, if one is named."""
    return asked.sparkSession.sql(
        inlined(
            f"""SELECT a.*, coalesce(IF(z > 0, (k + {m}D * (zk / z)) / (n + {m}D), IF(n > 0, k / n, 0D)), 0D) AS p FROM {{asked}} a LEFT JOIN <c> c USING (qid)""",
            side=f"""SELECT qid, sample, first, rest, 0 AS side FROM {{asked}} UNION ALL SELECT qid, prior, first, rest, 1 FROM {{asked}} WHERE prior IS NOT NULL""",
            c=f"""SELECT qid, count_if(side = 0 AND arrays_overlap(items, rest)) AS k, count_if(side = 0) AS n, count_if(side = 1 AND arrays_overlap(items, rest)) AS zk, count_if(side = 1) AS z
            FROM <side> side JOIN {{baskets}} b ON side.sample = b.sample WHERE n_items >= {well} AND array_contains(items, first) GROUP BY qid""",
        ),
        asked=asked, baskets=baskets,
    )
