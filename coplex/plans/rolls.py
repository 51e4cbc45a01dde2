"""Rolls of many seeds at once: a table of states, one row per seed, that goes through the facets in the jobs of one roll.

At a facet every state becomes a question; equal questions are asked once (batch.py), joined back, and each state draws with its
own hash-uniform numbers, all in array expressions. States are written after each facet, which cuts their lineage. Results are
those of roll.py for each seed."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coplex.sources.store import delete, staged

from . import batch as B
from .roll import Facet, Options

ROW = "struct<ord: int, facet: string, draw: int, status: string, tid: int, conf: double, lift: double, k: int, n: int, none_p: double, n_tiers: int>"
STATES = f"seed long, sample string, prior string, pre array<smallint>, picked array<smallint>, empty array<array<smallint>>, log array<{ROW}>"
DRAWN = "seed, ord, facet, draw, status, tag, conf, lift, k, n, none_p, n_tiers"


@dataclass
class World:
    """What all rolls share: samples by name (sample, items, entity, n_items), base rates (tid, n) of `total` baskets, the names of
    items (tid, tag), pair and single counts, lifts (sample, tid, lift) of anchors."""

    baskets: DataFrame
    rates: DataFrame
    total: int
    names: DataFrame
    pairs: DataFrame | None = None
    singles: DataFrame | None = None
    pair_total: int = 0
    lifts: DataFrame | None = None
    m: float = B.M
    well: int = B.WELL_TAGGED
    #: What has been written for the facet at hand.
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(staged(df, "roll"))
        return self.kept[-1]

    def next(self, states: DataFrame) -> DataFrame:
        """States written and read again; what they were made from is deleted."""
        out = staged(states.select("seed", "sample", "prior", "pre", "picked", "empty", "log"), "states")
        while self.kept:
            delete(self.kept.pop())
        return out


def begun(seeds: DataFrame, sample: str, prior: str | None, pre: Sequence[int] = ()) -> DataFrame:
    """States of (seed) before any facet. prior: the wide sample, if the other is small."""
    name = "CAST(NULL AS string)" if prior is None else f"'{prior}'"
    return seeds.selectExpr("seed", f"'{sample}' AS sample", f"{name} AS prior", f"{_shorts(pre)} AS pre", f"{_shorts(())} AS picked", "CAST(array() AS array<array<smallint>>) AS empty", f"CAST(array() AS array<{ROW}>) AS log")


def with_acts(states: DataFrame, acts: DataFrame, temperature: float) -> DataFrame:
    """States with the act that each draws from acts (tid, n) by n ** (1 / temperature), most frequent first."""
    t = 1 / max(0.1, temperature)
    one = acts.groupBy().agg(F.expr(f"transform(array_sort(collect_list(struct(-n AS s, tid, pow(n, {t}D) AS w))), x -> struct(int(x.tid) AS tid, x.w AS w))").alias("acts"))  # a facet's items
    return states.join(F.broadcast(one)).withColumn("act", F.expr(drawn("acts", uniform("act", 0)))).drop("acts")


def _shorts(x: Sequence[int]) -> str:
    return f"CAST(array({', '.join(str(int(v)) for v in x)}) AS array<smallint>)"


def _row(place: int, facet: str, draw: str, status: str, tid: str, figures: bool = False, none_p: str = "NULL") -> str:
    c = f"filter(cands, c -> c.tid = {tid})[0]" if figures else None
    shown = [f"round(get(filter(cands, c -> c.tid = {tid}), 0).{x}, {d})" if c else "NULL" for x, d in (("conf", 4), ("lift", 2), ("k", 0))]
    values = [str(place), f"'{facet}'", draw, f"'{status}'", tid, shown[0], shown[1], f"int({shown[2]})", "int(round(n))" if figures else "NULL", f"round({none_p}, 3)", "n_tiers" if figures else "NULL"]
    names = [x.split(":")[0].strip() for x in ROW[7:-1].split(",")]
    return f"CAST(named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(names, values, strict=True))}) AS {ROW})"


def noted(states: DataFrame, *rows: str) -> DataFrame:
    return states.withColumn("log", F.expr(f"concat(log, array({', '.join(rows)}))")) if rows else states


def uniform(facet: str, number: int) -> str:
    return f"((CAST(conv(substring(md5(concat_ws('#', string(seed), '{facet}', '{number}')), 1, 12), 16, 10) AS double) + 0.5D) / 281474976710656D)"


def drawn(weights: str, u: str) -> str:
    """The first of the weights (tid, w) whose running sum reaches u of the total; null if there is none."""
    start = "struct(0D AS run, CAST(NULL AS int) AS tid, false AS done)"
    total = f"aggregate({weights}, 0D, (a, x) -> a + x.w)"
    step = f"(a, x) -> CASE WHEN NOT a.done AND x.w > 0 AND a.run + x.w >= {u} * total THEN struct(a.run + x.w AS run, x.tid AS tid, true AS done) ELSE struct(a.run + x.w AS run, a.tid AS tid, a.done AS done) END"
    return f"get(transform(array({total}), total -> aggregate({weights}, {start}, {step}).tid), 0)"


def asked(states: DataFrame, world: World, pool: str, gone: str, whole: bool, absent: Sequence[int] = (), beta: float | None = None, top: int | None = 12, adjust: bool = False, required: bool = False) -> DataFrame:
    """States with the answer to their question: n, n_tiers, cands, none_p. pool, gone: arrays of items, as SQL over a state. whole: none
    is none of the whole pool, not of the candidates. adjust: by the pair lifts with what is picked."""
    items = f"CAST(concat(transform(concat(pre, picked), t -> struct(true AS tag, array(t) AS keys)), transform(empty, k -> struct(false AS tag, k AS keys))) AS {B.ITEMS})"
    asks = f"CAST({f'array(struct({pool} AS pool, {world.well} AS well, {_shorts(absent)} AS absent))' if whole else 'array()'} AS {B.ASKS})"
    keyed = states.withColumns({"items": F.expr(items), "pool": F.expr(pool), "gone": F.expr(f"array_sort({gone})"), "asks": F.expr(asks)})
    keyed = keyed.withColumn("qid", F.expr("sha2(to_json(struct(sample, prior, items, picked, pool, gone, asks)), 256)"))
    questions = keyed.select("qid", "sample", "prior", "items", "pool", "gone", "asks", "picked").dropDuplicates(["qid"])
    questions = world.keep(questions)
    found = B.answered(questions.drop("picked"), world.baskets, world.rates, world.total, world.m, world.lifts, beta, top, None if whole else world.well, world.keep)
    # a facet without items, or without candidates of its own to be none of, is empty for sure
    known = "size(pool) > 0" if whole else "size(cands) > 0"
    found = found.join(questions.select("qid", "pool", "picked"), "qid").withColumn("none_p", F.expr(f"IF({known}, greatest({B.NONE_LEAST}D, 1 - asks[0]), 1D)"))
    found = found.withColumn("n", F.expr("IF(size(pool) > 0, n, 0D)"))
    if adjust and world.pairs is not None:
        found = adjusted(world.keep(found), world, required)
    answer = world.keep(found.select("qid", "n", "n_tiers", "cands", "none_p"))
    return keyed.drop("items", "pool", "gone", "asks").join(answer, "qid").drop("qid")


def adjusted(found: DataFrame, world: World, required: bool) -> DataFrame:
    """Confidences times the product of their pair lifts with what is picked, within [0.02, 20]; the chance of none follows their
    sum unless the facet is required."""
    spark = found.sparkSession
    factors = spark.sql(
        B.inlined(
            f"""SELECT qid, map_from_entries(collect_list(struct(y, f))) AS f FROM (SELECT qid, y, aggregate(array_sort(collect_list(lift)), 1D, (a, x) -> a * x) AS f FROM <l> l GROUP BY qid, y) GROUP BY qid""",
            one=f"""SELECT qid, x, c.tid AS y FROM (SELECT qid, cands, explode(picked) AS x FROM {{found}}) LATERAL VIEW explode(cands) AS c""",
            l=f"""SELECT qid, y, IF(s.n >= 100 AND t.n > 0, (coalesce(n_ab, 0) / s.n) / (t.n / {float(world.pair_total)}D), NULL) AS lift
            FROM <one> one LEFT JOIN {{pairs}} p ON least(x, y) = p.a AND greatest(x, y) = p.b LEFT JOIN {{singles}} s ON x = s.tid LEFT JOIN {{singles}} t ON y = t.tid""",
        ),
        found=found, pairs=world.pairs, singles=world.singles,
    )
    sums = lambda x: f"aggregate({x}, 0D, (a, c) -> a + c.conf)"
    out = found.join(factors, "qid", "left").withColumn("before", F.expr(sums("cands")))
    out = out.withColumn("cands", F.expr("transform(cands, c -> struct(c.tid, c.conf * IF(f IS NULL, 1D, least(20D, greatest(0.02D, coalesce(f[c.tid], 1D)))) AS conf, c.lift, c.k))"))
    none_p = "none_p" if required else f"IF(f IS NULL OR before <= 0, none_p, least({B.NONE_MOST}D, 1 - (1 - none_p) * least(1D, {sums('cands')} / before)))"
    return out.withColumn("none_p", F.expr(none_p)).drop("f", "before")


def weights(states: DataFrame, required: bool, temperature: float, beta: float | None = None) -> DataFrame:
    """States with weights array<struct<tid, w>> of their candidates and none_w."""
    t = 1 / max(0.1, temperature)
    conf = f"c.conf * pow(c.lift, {beta}D)" if beta else "c.conf"
    scale = "1D" if required else f"((1 - none_p) / greatest(aggregate(cands, 0D, (a, c) -> a + {conf}), 1e-9D))"
    return states.withColumns({"weights": F.expr(f"transform(cands, c -> struct(c.tid AS tid, pow({conf} * {scale}, {t}D) AS w))"), "none_w": F.expr(f"pow(none_p, {t}D)")})


def drawing(states: DataFrame, facet: str, number: int, offer_none: str, taken: str) -> DataFrame:
    """States with draw_<number>: one of the weights that isn't taken, or none."""
    left = f"concat(filter(weights, x -> NOT array_contains({taken}, x.tid)), IF({offer_none}, array(struct(CAST(NULL AS int) AS tid, none_w AS w)), array()))"
    held = states.withColumn("left", F.expr(left))
    return held.withColumn(f"draw_{number}", F.expr(drawn("left", uniform(facet, number)))).drop("left")


def _given(options: Options, facet: str) -> list[int] | None:
    if facet not in options.fixed:
        return None
    value = options.fixed[facet]
    return [] if value in ("", None) else list(value) if isinstance(value, (list, tuple)) else [value]


def shown(states: DataFrame, world: World) -> DataFrame:
    """(seed, ord, facet, draw, status, tag, conf, lift, k, n, none_p, n_tiers): the logs of all states."""
    rows = states.select("seed", F.explode("log").alias("x")).select("seed", "x.*")
    return rows.join(world.names.select("tid", "tag"), "tid", "left").selectExpr(*DRAWN.split(", "))


def roll_designs(world: World, states: DataFrame, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), mode: str = "dressed", default_off: Collection[str] = (), mode_off: Mapping[str, Collection[str]] = {}, covering: Collection[str] = (), bare_item: int | None = None) -> DataFrame:
    """roll_design() of every seed; options.seed is not read."""
    on = set(options.on) if options.on is not None else {f.name for f in facets} - set(default_off)
    on -= set(mode_off.get(mode, ()))
    bare = mode in mode_off and mode != "dressed" or not on & set(covering) if covering else False
    if bare and bare_item is not None:
        states = states.withColumn("pre", F.expr(f"concat(pre, {_shorts([bare_item])})"))
    place_of = {a: next((f.name for f in facets if a in f.pool), None) for a in anchors}
    extra = [a for a in anchors if place_of[a] is None]
    states = noted(states, *(_row(-1, "anchor_extra", str(i), "anchor", str(a)) for i, a in enumerate(extra)))
    for i, f in enumerate(facets):
        if own := [a for a in anchors if place_of[a] == f.name]:
            states = noted(states, *(_row(i, f.name, str(k), "anchor", str(a)) for k, a in enumerate(own)))
            continue
        if f.name not in on:
            states = noted(states, _row(i, f.name, "0", "off", "NULL"))
            continue
        required, given = options.requires(f.name), _given(options, f.name)
        gone = f"array_union({_shorts(sorted(set(anchors) | set(options.gone)))}, picked)"
        states = asked(states, world, _shorts(f.pool), gone, True, f.absent, options.beta)
        states = weights(states, required, options.temperature, options.beta)
        if given is not None:
            states = states.withColumn("draw_0", F.lit(given[0] if given else None).cast("int"))
        else:
            states = drawing(states, f.name, 0, str(not required).lower(), _shorts(()))
        lost = "size(cands) = 0" if required else "false"
        chosen = f"IF({lost}, NULL, draw_0)"
        row = f"IF({lost}, {_row(i, f.name, '0', 'no candidates', 'NULL', True)}, {_row(i, f.name, '0', 'fixed' if given is not None else 'drawn', 'draw_0', True, 'NULL' if required else 'none_p')})"
        states = states.withColumn("log", F.expr(f"concat(log, array({row}))"))
        if f.none_in_query:
            states = states.withColumn("empty", F.expr(f"IF({chosen} IS NULL AND NOT {lost}, concat(empty, array({_shorts(f.exclusive or f.pool)})), empty)"))
        states = world.next(states.withColumn("picked", F.expr(f"IF({chosen} IS NULL, picked, concat(picked, array(smallint({chosen}))))")))
    return shown(states, world)


def _several(world: World, states: DataFrame, i: int, f: Facet, number: int, options: Options, required: bool, offer_none: Sequence[str], given: list[int] | None, none_p: str, loose: bool = False) -> DataFrame:
    """States after up to `number` draws of a facet, the next one only after one that gave an item. Given items hold among the
    candidates; if loose, draws are made where the first of them is none."""
    status = "fixed" if given is not None else "drawn"
    none = _shorts(())
    if loose or given is None:
        states = weights(states, required, options.temperature, options.beta)
        states = states.withColumn("picks", F.expr(none)).withColumn("goes_on", F.expr("size(cands) > 0" if number else "false"))
        for k in range(number):
            states = drawing(states, f.name, k, offer_none[k], "picks")
            states = states.withColumn("goes_on", F.expr(f"goes_on AND draw_{k} IS NOT NULL")).withColumn("picks", F.expr(f"IF(goes_on, concat(picks, array(smallint(draw_{k}))), picks)"))
    if given is not None:
        inside = f"filter({_shorts(given)}, t -> exists(cands, c -> c.tid = t))" if number else none
        states = states.withColumn("picks", F.expr(f"IF(exists(cands, c -> c.tid = {given[0]}), {inside}, picks)" if loose else inside))
    rows = f"transform(IF(size(picks) > 0, CAST(picks AS array<int>), array(CAST(NULL AS int))), (t, d) -> {_row(i, f.name, 'd', status, 't', True, none_p)})"
    return world.next(states.withColumns({"log": F.expr(f"concat(log, {rows})"), "picked": F.expr("concat(picked, picks)")}))


def roll_conditioned(world: World, states: DataFrame, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), top: int | None = 12) -> DataFrame:
    """roll_pose() of every seed, or with top None roll_expression(); the design is the states' pre."""
    mine: dict[str, int] = {}
    for a in anchors:
        if (name := next((f.name for f in facets if a in f.pool), None)) and name not in mine:
            mine[name] = a
    gone = set(anchors) | set(options.gone)
    for i, f in enumerate(facets):
        if f.name in mine:
            states = noted(states, _row(i, f.name, "0", "anchor", str(mine[f.name]))).withColumn("picked", F.expr(f"concat(picked, {_shorts([mine[f.name]])})"))
            continue
        if options.on is not None and f.name not in options.on:
            states = noted(states, _row(i, f.name, "0", "off", "NULL"))
            continue
        must, given = options.requires(f.name), _given(options, f.name)
        states = asked(states, world, _shorts([t for t in f.pool if t not in gone]), "picked", False, top=top, adjust=True, required=must)
        states = _several(world, states, i, f, f.draws, options, must, [str(not must).lower()] * f.draws, given, "IF(size(cands) > 0, NULL, none_p)" if must else "none_p", bool(given) and top is not None)
    return shown(states, world)


def roll_adults(world: World, states: DataFrame, facets: Sequence[Facet], options: Options = Options(), design: Sequence[tuple[str, int]] = (), body: int | None = None, level: int = 2, bare: bool = False, strips: Mapping[int, Collection[str]] = {}) -> DataFrame:
    """roll_adult() of every seed. States have been begun with their act (column act), whose sample they name."""
    pre = [t for _, t in design] + ([body] if body is not None and body not in [t for _, t in design] else [])
    acts = states.select("seed", "act")
    states = noted(states.withColumn("pre", F.expr(_shorts(pre))), _row(0, "act", "0", "drawn", "act")).drop("act")
    for i, f in enumerate(facets, 1):
        if options.on is not None and f.name not in options.on or bare and f.role == "clothes":
            states = noted(states, _row(i, f.name, "0", "off", "NULL"))
            continue
        must, given, k = options.requires(f.name), _given(options, f.name), f.draws_by_level.get(level, f.draws)
        states = states.join(acts, "seed")
        pool = f"array_except({_shorts([t for t in f.pool if t not in options.gone])}, array(smallint(act)))"
        states = asked(states, world, pool, "picked", False, top=12).drop("act")
        # none is offered at the first draw only; without candidates one draw is made of none alone
        offers = [str(not must).lower() if n == 0 else "false" for n in range(k)]
        states = _several(world, states, i, f, k, options, must, offers, given, "NULL" if not k else "IF(size(cands) > 0, NULL, none_p)" if must else "none_p")
    for name, tid in design:
        gone = _shorts([t for t, facets_off in strips.items() if name in facets_off])
        row = f"IF(arrays_overlap(picked, {gone}), {_row(len(facets) + 1, name, '0', 'stripped', str(tid))}, {_row(len(facets) + 1, name, '0', 'kept', str(tid))})"
        states = noted(states, row)
    return shown(states, world)
