"""Rolls: facets in order, each drawn from its conditional distribution given what has been drawn.

Five modules share the questions (Scope.ask) and the draws, and differ in samples, in when none is offered, and in a few
rules of their own. A roll runs on the driver, one facet after the other, as each question depends on the draws before
it; every question is a few Spark aggregations over the sample, and what comes back are a facet's candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coplex.operators.counts import pair_lifts
from coplex.operators.samples import is_small, uniform

from . import ladder as L

ROLLED = "ord int, facet string, draw int, status string, tag string, conf double, lift double, k int, n int, none_p double, n_tiers int"
#: Most draws of a background facet.
BACKGROUNDS = 2


@dataclass(frozen=True)
class Facet:
    """exclusive: the pool's items that no facet before has (asked for when the facet is empty). draws_by_level: draws of an
    adult facet. solid: backgrounds that the umbrella item goes with. fallback: items to ask for where the pool gives no
    candidate."""

    name: str
    pool: tuple[int, ...]
    exclusive: tuple[int, ...] = ()
    absent: tuple[int, ...] = ()
    none_in_query: bool = False
    draws: int = 1
    draws_by_level: Mapping[int, int] = field(default_factory=dict)
    role: str = ""
    solid: tuple[int, ...] = ()
    umbrella: int | None = None
    fallback: tuple[int, ...] = ()


@dataclass(frozen=True)
class Options:
    """fixed: a facet's given items ("" or an empty list: none). must: True, or facets that are never empty. on: facets that
    are rolled, all if None. gone: items that no facet may draw."""

    seed: int = 0
    temperature: float = 1.0
    beta: float | None = None
    fixed: Mapping[str, object] = field(default_factory=dict)
    must: bool | Collection[str] = False
    on: Collection[str] | None = None
    gone: Collection[int] = ()

    def requires(self, facet: str) -> bool:
        return self.must is True or bool(self.must) and facet in self.must


@dataclass
class Answer:
    n: int
    n_tiers: int
    cands: list[tuple]
    none_p: float


def random_number(*parts: object) -> float:
    """The driver's twin of samples.uniform."""
    return (int(hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / float(1 << 48)


def weights(confs: Sequence[float], none_p: float, required: bool, temperature: float) -> list[float]:
    """Draw weights of candidates, and of none as the last unless required."""
    t = 1 / max(0.1, temperature)
    if required:
        return [c**t for c in confs]
    scale = (1 - none_p) / max(sum(confs), 1e-9)
    return [*((c * scale) ** t for c in confs), none_p**t]


def pick(values: Sequence[float], u: float) -> int | None:
    """The first index whose running sum reaches u of the total."""
    total, run = sum(values), 0.0
    for i, v in enumerate(values):
        run += v
        if total > 0 and run >= u * total and v > 0:
            return i
    return None


def draw(weighted: DataFrame, seed: int, group: str = "facet", order: str = "tid") -> DataFrame:
    """One row of each group by weight: inverse of the running sum at a hash-uniform number. Groups are candidates
    of one facet, a dozen rows."""
    w = Window.partitionBy(group)
    run = F.sum("weight").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reach = weighted.filter("weight > 0").withColumns({"_run": run, "_goal": uniform(F.lit(seed), F.col(group)) * F.sum("weight").over(w)})
    return reach.filter(F.col("_run") >= F.col("_goal")).withColumn("_rank", F.row_number().over(w.orderBy("_run", order))).filter("_rank = 1").drop("_run", "_goal", "_rank")


def draw_several(weighted: DataFrame, k: int, seed: int, group: str = "facet", order: str = "tid") -> DataFrame:
    """At most k rows of each group without replacement: an exponential race, least -ln(u) / weight first."""
    race = -F.ln(uniform(F.lit(seed), F.col(group), F.col(order))) / F.col("weight")
    ranked = weighted.filter("weight > 0").withColumn("_race", race).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_race", order)))
    return ranked.filter(F.col("place") <= k).drop("_race")


@dataclass
class Scope:
    """What a roll asks: its sample; a wide sample to smooth with where that is small; the anchors' sample, if the other is
    also cut by segment; base rates; pair counts."""

    sample: DataFrame
    rates: DataFrame
    total: int
    names: Mapping[int, str]
    prior: DataFrame | None = None
    lift_of: DataFrame | None = None
    pairs: DataFrame | None = None
    singles: DataFrame | None = None
    pair_total: int = 0
    m: float = L.M
    well: int = L.WELL_TAGGED

    @classmethod
    def of(cls, sample: DataFrame, wide: Callable[[], DataFrame], *args, lift_of: Callable[[], DataFrame] | None = None, m: float = L.M, small: bool | None = None, **more) -> Scope:
        """A scope that smooths with the wide sample only if its own is small; whether it is can be given."""
        if small is None:
            small = is_small(sample.count(), m, L.STOP)
        return cls(sample, *args, prior=wide() if small else None, lift_of=lift_of() if small and lift_of else None, m=m, **more)

    @property
    def spark(self) -> SparkSession:
        return self.sample.sparkSession

    def ask(self, items: Sequence[L.Item], pool: Sequence[int], gone: Collection[int] = (), none_pool: Sequence[int] | None = None, top: int | None = 12, beta: float | None = None, absent: Sequence[int] = (), sample: DataFrame | None = None) -> Answer:
        """Candidates of the pool and the chance of none of none_pool (of the candidates, without it). A sample of its own is
        asked without a prior."""
        t = L.tiers(self.sample if sample is None else sample, items, self.m)
        p = L.tiers(self.prior, items, self.m) if self.prior is not None and sample is None else None
        n = round(t.levels[0].n) if t.levels else 0
        if not pool:
            return Answer(0, t.n_tiers, [], 1.0)
        lifts = L.anchor_lift(self.lift_of, pool, self.rates, self.total, self.m) if self.lift_of is not None and p is not None else None
        base = L.prior_for(p, pool, lifts) if p is not None else None
        found = L.candidates(L.ladder(t, pool, base), self.rates, self.total, sorted(gone), beta, top=top)
        cands = [(r["tid"], r["conf"], r["lift"], round(r["k"])) for r in found.collect()]
        asked = list(none_pool) if none_pool else [c[0] for c in cands]
        return Answer(n, t.n_tiers, cands, L.none_prob(t, asked, self.well, absent, p) if asked else 1.0)

    def adjusted(self, answer: Answer, picked: Sequence[int], required: bool) -> Answer:
        """The answer after the pair lifts with what is picked."""
        if self.pairs is None or not picked or not answer.cands:
            return answer
        asked = self.spark.createDataFrame([(x, c[0]) for x in picked for c in answer.cands], "x int, y int")
        known = {(r["x"], r["y"]): r["lift"] for r in pair_lifts(asked, self.pairs, self.singles, self.pair_total).collect()}
        cands, none_p = L.pair_adjust(answer.cands, known, picked, answer.none_p, required)
        return Answer(answer.n, answer.n_tiers, cands, none_p)


class Log:
    """Rows of ROLLED, rounded as results are shown."""

    def __init__(self, scope: Scope):
        self.scope, self.rows = scope, []

    def add(self, place: int, facet: str, status: str, tids: Sequence[int | None] = (None,), answer: Answer | None = None, none_p: float | None = None) -> None:
        for number, tid in enumerate(tids or (None,)):
            conf, lift, k = next((c[1:4] for c in answer.cands if c[0] == tid), (None, None, None)) if answer else (None, None, None)
            rounded = [None if x is None else round(x, d) for x, d in ((conf, 4), (lift, 2))]
            self.rows.append((place, facet, number, status, self.scope.names.get(tid), *rounded, k, answer.n if answer else None, None if none_p is None else round(none_p, 3), answer.n_tiers if answer else None))

    def frame(self) -> DataFrame:
        return self.scope.spark.createDataFrame(self.rows, ROLLED)


def query(tags: Sequence[int], empty: Sequence[Facet] = ()) -> list[L.Item]:
    return [*(("tag", t) for t in tags), *(("none", f.exclusive or f.pool) for f in empty)]


def _given(options: Options, facet: str) -> list[int] | None:
    """The fixed items of a facet; [] for a fixed none, None if nothing is fixed."""
    if facet not in options.fixed:
        return None
    value = options.fixed[facet]
    return [] if value in ("", None) else list(value) if isinstance(value, (list, tuple)) else [value]


def _draw(answer: Answer, options: Options, facet: str, number: int, offer_none: bool, taken: Sequence[int] = ()) -> int | None:
    """One candidate that isn't taken, or none. Weights are scaled over all candidates."""
    confs = [c[1] * (c[2] ** options.beta if options.beta else 1.0) for c in answer.cands]
    every = weights(confs, answer.none_p, not offer_none and options.requires(facet), options.temperature)
    left = [(c[0], w) for c, w in zip(answer.cands, every, strict=False) if c[0] not in taken]
    if offer_none:
        left.append((None, every[-1]))
    at = pick([w for _, w in left], random_number(options.seed, facet, number))
    return left[at][0] if at is not None else None


def roll_design(scope: Scope, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), mode: str = "dressed", default_off: Collection[str] = (), mode_off: Mapping[str, Collection[str]] = {}, covering: Collection[str] = (), bare_item: int | None = None) -> DataFrame:
    """Anchors stay in their facets, or in a row of their own. A mode takes its facets away; bare modes, and rolls without any
    covering facet, ask for bare_item too. A fixed item holds even outside the candidates. A facet that comes out empty joins
    the questions of later ones if none_in_query says so."""
    log, picked, empty = Log(scope), [], []
    on = set(options.on) if options.on is not None else {f.name for f in facets} - set(default_off)
    on -= set(mode_off.get(mode, ()))
    bare = mode in mode_off and mode != "dressed" or not on & set(covering) if covering else False
    pre = [bare_item] if bare and bare_item is not None else []
    gone = set(anchors) | set(options.gone)
    place_of = {a: next((f.name for f in facets if a in f.pool), None) for a in anchors}
    if extra := [a for a in anchors if place_of[a] is None]:
        log.add(-1, "anchor_extra", "anchor", extra)
    for i, f in enumerate(facets):
        if own := [a for a in anchors if place_of[a] == f.name]:
            log.add(i, f.name, "anchor", own)
            continue
        if f.name not in on:
            log.add(i, f.name, "off")
            continue
        required, given = options.requires(f.name), _given(options, f.name)
        answer = scope.ask(query(pre + picked, empty), f.pool, gone | set(picked), f.pool, beta=options.beta, absent=f.absent)
        if required and not answer.cands:
            log.add(i, f.name, "no candidates", answer=answer)
            continue
        if given is not None and (not given or given[0] in scope.names):
            chosen = given[0] if given else None
        else:
            chosen = _draw(answer, options, f.name, 0, not required) if answer.cands or not required else None
        if chosen is not None:
            picked.append(chosen)
        elif f.none_in_query:
            empty.append(f)
        log.add(i, f.name, "fixed" if given is not None else "drawn", [chosen], answer, None if required else answer.none_p)
    return log.frame()


def act_weights(rates: DataFrame, pool: DataFrame) -> DataFrame:
    """(tag, n) of the acts that occur at all."""
    return rates.join(pool.select("tag"), "tag", "left_semi").filter("n > 0").select("tag", "n")


def roll_adult(scope_of: Callable[[int], Scope], facets: Sequence[Facet], acts: Sequence[tuple[int, int]], options: Options = Options(), act: int | None = None, design: Sequence[tuple[str, int]] = (), body: int | None = None, level: int = 2, bare: bool = False, strips: Mapping[int, Collection[str]] = {}) -> DataFrame:
    """An act, given or drawn by frequency ** (1 / T), names the sample. Every facet is asked once; none is offered on the
    first of its draws only, and their number depends on the level. What is picked strips facets of the design (status
    stripped, one row each)."""
    chosen_act = act
    if chosen_act is None:
        at = pick([n ** (1 / max(0.1, options.temperature)) for _, n in acts], random_number(options.seed, "act", 0))
        chosen_act = acts[at][0] if at is not None else None
    scope = scope_of(chosen_act)
    log, picked = Log(scope), []
    log.add(0, "act", "anchor" if act is not None else "drawn", [chosen_act])
    pre = [t for _, t in design]
    if body is not None and body not in pre:
        pre.append(body)
    for i, f in enumerate(facets, 1):
        if options.on is not None and f.name not in options.on or bare and f.role == "clothes":
            log.add(i, f.name, "off")
            continue
        pool = [t for t in f.pool if t != chosen_act and t not in options.gone]
        answer = scope.ask(query(pre + picked), pool, picked)
        required = options.requires(f.name) and bool(answer.cands)
        k, given, picks = f.draws_by_level.get(level, f.draws), _given(options, f.name), []
        if given is not None:
            picks = [t for t in given if any(c[0] == t for c in answer.cands)] if k else []
        else:
            for number in range(min(k, len(answer.cands) or 1)):
                one = _draw(answer, options, f.name, number, number == 0 and not required, picks)
                if one is None:
                    break
                picks.append(one)
        picked += picks
        log.add(i, f.name, "fixed" if given is not None else "drawn", picks, answer, None if required or not k else answer.none_p)
    gone = set().union(*(strips.get(t, ()) for t in picked)) if picked else set()
    for name, tid in design:
        log.add(len(facets) + 1, name, "stripped" if name in gone else "kept", [tid])
    return log.frame()


def _conditioned(scope: Scope, facets: Sequence[Facet], anchors: Sequence[int], options: Options, design: Sequence[int], top: int | None, special: Callable[..., bool] | None = None, gone: Collection[int] = ()) -> DataFrame:
    """Pose, expression and the plain facets of a scene: the design comes first in every question, pair lifts with what is
    picked adjust candidates, fixed items hold only among these."""
    log, picked = Log(scope), []
    gone = set(anchors) | set(gone) | set(options.gone)
    mine: dict[str, int] = {}
    for a in anchors:
        if (name := next((f.name for f in facets if a in f.pool), None)) and name not in mine:
            mine[name] = a
    for i, f in enumerate(facets):
        if f.name in mine:
            log.add(i, f.name, "anchor", [mine[f.name]])
            picked.append(mine[f.name])
            continue
        if options.on is not None and f.name not in options.on:
            log.add(i, f.name, "off")
            continue
        if special and special(i, f, log, picked, gone):
            continue
        items, pool = query([*design, *picked]), [t for t in f.pool if t not in gone]
        answer = scope.ask(items, pool, picked, top=top)
        if f.fallback and not answer.cands:
            answer = scope.ask(items, f.fallback, picked, top=top)
        required, given = options.requires(f.name) and bool(answer.cands), _given(options, f.name)
        answer = scope.adjusted(answer, picked, required)
        inside = lambda t, found=answer: any(c[0] == t for c in found.cands)
        picks: list[int] = []
        if given is not None and (top is None or not given or inside(given[0])):
            picks = [t for t in given if inside(t)]
        else:
            for number in range(f.draws):
                one = _draw(answer, options, f.name, number, not required, picks) if answer.cands else None
                if one is None:
                    break
                picks.append(one)
        picked += picks
        log.add(i, f.name, "fixed" if given is not None else "drawn", picks, answer, None if required else answer.none_p)
    return log.frame()


def roll_pose(scope: Scope, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), design: Sequence[int] = ()) -> DataFrame:
    """One draw per facet."""
    return _conditioned(scope, facets, anchors, options, design, 12)


def roll_expression(scope: Scope, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), design: Sequence[int] = ()) -> DataFrame:
    """All items of a pool are candidates; a facet may be drawn from several times, with none offered each time."""
    return _conditioned(scope, facets, anchors, options, design, None)


def roll_scene(scope: Scope, facets: Sequence[Facet], anchors: Sequence[int], options: Options = Options(), design: Sequence[int] = (), wide: Callable[[], DataFrame] | None = None, background: str = "auto", frame: object = "auto", removed: Collection[int] = ()) -> DataFrame:
    """The facet of role frame is asked without anchors or query, over the wide sample. The one of role background is drawn
    from twice at most: the second draw is conditioned on the first, its chance of none is the pair share; a solid one
    brings the umbrella item. removed items leave the background's candidates but count for its none. The fallback acts
    where a facet has no candidate."""

    def special(i: int, f: Facet, log: Log, picked: list[int], gone: set[int]) -> bool:
        given = _given(options, f.name)
        if f.role == "frame":
            if frame == "off":
                log.add(i, f.name, "off")
                return True
            pool = [t for t in f.pool if t not in options.gone]
            answer = scope.ask([], pool, (), pool, sample=wide() if wide else scope.sample)
            required = options.requires(f.name) and bool(answer.cands)
            if frame != "auto":
                chosen = frame
            elif given is not None and (not given or any(c[0] == given[0] for c in answer.cands)):
                chosen = given[0] if given else None
            else:
                chosen = _draw(answer, options, f.name, 0, not required) if answer.cands else None
            picked += [chosen] if chosen is not None else []
            log.add(i, f.name, "fixed" if frame != "auto" or given is not None else "drawn", [chosen], answer, None if required else answer.none_p)
            return True
        if f.role != "background":
            return False
        if background == "real":
            log.add(i, f.name, "off")
            return True
        whole = [t for t in f.pool if t not in gone]
        picks, shown, none_p = [], None, None
        for number in range(BACKGROUNDS):
            rest = [t for t in whole if t not in picks]
            answer = scope.ask(query([*design, *picked, *picks]), [t for t in rest if t not in removed], [*picked, *picks], rest)
            if number and answer.cands:
                answer.none_p = max(L.NONE_LEAST, 1 - L.pair_share(scope.sample, picks[0], rest, scope.m, scope.prior, scope.well))
            elif not answer.cands:
                answer.none_p = 1.0
            required = background == "simple" and number == 0 and bool(answer.cands)
            if shown is None:
                shown, none_p = answer, None if required else answer.none_p
            if given is not None:
                one = given[number] if number < len(given) else None
            elif not answer.cands:
                one = None
            else:
                confs = weights([c[1] for c in answer.cands], answer.none_p, required, options.temperature)
                at = pick(confs, random_number(options.seed, f.name, number))
                one = answer.cands[at][0] if at is not None and at < len(answer.cands) else None
            if one is None:
                break
            picks.append(one)
        if f.umbrella is not None and set(picks) & set(f.solid):
            picked.append(f.umbrella)
            log.add(i, f.name + "_umbrella", "added", [f.umbrella])
        picked += picks
        log.add(i, f.name, "fixed" if given is not None else "drawn", picks, shown, none_p)
        return True

    return _conditioned(scope, facets, anchors, options, design, 12, special)


def roll_chain(modules: Sequence[tuple[str, Callable[[list[int]], DataFrame]]], tid: Mapping[str, int]) -> DataFrame:
    """Modules one after the other: each is given the picks of those before it, and its own come after them. Rows have their module
    and its number; anchors and what is added are no picks."""
    picks: list[int] = []
    out = None
    for number, (name, roll) in enumerate(modules):
        rolled = roll(list(picks))
        own = rolled.filter(F.col("status").isin("drawn", "fixed") & F.col("tag").isNotNull()).orderBy("ord", "draw").collect()  # a module's facets
        picks += [tid[r["tag"]] for r in own if tid[r["tag"]] not in picks]
        one = rolled.select(F.lit(number).alias("number"), F.lit(name).alias("module"), "*")
        out = one if out is None else out.unionByName(one)
    return out
