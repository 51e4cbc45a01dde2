"""Tables of questions give the known results of single ones; rolls of many seeds give those of each seed."""

import pytest
from pyspark.sql import functions as F
from test_ladder import CASES, world  # noqa: F401  a fixture
from test_roll import NAMES, X, Y, scope  # noqa: F401  a fixture

from coplex.plans import batch as B
from coplex.plans import ladder as L
from coplex.plans import roll as R
from coplex.plans import rolls as M


def ask(spark, rows):
    return spark.createDataFrame(rows, B.QUESTIONS)


def test_known_results_in_one_plan(spark, world):  # noqa: F811
    sample, tid = world
    rows = []
    for case, (asked, pool, *_) in CASES.items():
        items = [(isinstance(x, str), [tid[x]] if isinstance(x, str) else [tid[t] for t in x]) for x in asked]
        ids = [tid[x] for x in pool]
        rows += [(case + str(i), "s", None, order, ids, [], [(ids, B.WELL_TAGGED, [])]) for i, order in enumerate((items, items[::-1]))]
    rows.append(("empty", "none", None, [(True, [tid["dress"]])], [tid["shirt"]], [], [([tid["shirt"]], 0, [])]))
    questions = ask(spark, rows)
    baskets = sample.withColumn("sample", F.lit("s"))
    sides = B.sided(questions)
    found = B.matches(sides, baskets)
    tiers = B.tiers(found)
    sizes = {r.qid: sorted(r.sizes) for r in tiers.groupBy("qid").agg(F.collect_list("size").alias("sizes")).collect()}
    got = {r.qid: r for r in B.shares(questions, B.weighted(found, B.levels(tiers)), spark.createDataFrame([], "tid int, n long")).collect()}
    names = {v: k for k, v in tid.items()}
    for case, (_, pool, want, n_top, shares, none_p) in CASES.items():
        for i in "01":
            r = got[case + i]
            assert sizes[case + i] == want and round(r.n) == n_top and r.n_tiers == len(want)
            assert {names[x.tid]: round(x.p, 6) for x in r["items"]} == pytest.approx(shares, abs=1e-6) and len(r["items"]) == len(pool)
            assert max(B.NONE_LEAST, 1 - r.asks[0]) == pytest.approx(none_p, abs=1e-6)
    assert got["empty"].n == 0 and got["empty"]["items"][0].p == 0 and list(got["empty"].asks) == [0.0]


def test_smoothing_by_a_wide_sample(spark, world):  # noqa: F811
    sample, tid = world
    small, pool = sample.filter("pid % 5 = 0"), [tid[x] for x in ("dress", "shirt", "swimsuit")]
    rates = sample.select(F.explode(F.col("items").cast("array<int>")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    query = [("tag", tid["black_hair"])]
    lifts = B.anchor_lifts(small.withColumn("sample", F.lit("a")), rates, 200)
    assert {r.tid: round(r.lift, 9) for r in lifts.filter(F.col("tid").isin(pool)).collect()} == {r["tid"]: round(r["lift"], 9) for r in L.anchor_lift(small, pool, rates, 200).collect()}
    base = L.prior_for(L.tiers(sample, query), pool, L.anchor_lift(small, pool, rates, 200))
    want = {r["tid"]: r["p"] for r in L.ladder(L.tiers(small, query), pool, base).collect()}
    none = L.none_prob(L.tiers(small, query), pool, 0, prior=L.tiers(sample, query))
    questions = ask(spark, [("q", "a", "b", [(True, [tid["black_hair"]])], pool, [pool[0]], [(pool, 0, [])])])
    both = small.withColumn("sample", F.lit("a")).unionByName(sample.withColumn("sample", F.lit("b")))
    r = B.answered(questions, both, rates, 200, lifts=lifts).first()
    assert {c.tid: c.conf for c in r.cands} == pytest.approx({k: v for k, v in want.items() if k != pool[0]}) and 1 - r.asks[0] == pytest.approx(none)
    pair = spark.createDataFrame([("q", "a", "b", pool[0], pool[1:])], "qid string, sample string, prior string, first smallint, rest array<smallint>")
    assert B.pair_shares(pair, both).first().p == pytest.approx(L.pair_share(small, pool[0], pool[1:], prior=sample))


def many(spark, scope, n, pre=()):  # noqa: F811
    own = scope.sample.select(F.lit("own").alias("sample"), "items", "entity", "n_items").cache()
    names = spark.createDataFrame(list(NAMES.items()), "tid int, tag string")
    made = M.World(own, scope.rates, 400, names, scope.pairs, scope.singles, 400, well=2)
    return made, M.begun(spark.range(n).selectExpr("id AS seed"), "own", None, pre)


def rows(df, seed=None):
    columns = [c for c in M.DRAWN.split(", ") if c != "seed"]
    kept = df if seed is None else df.filter(F.col("seed") == seed)
    return sorted((tuple(r) for r in kept.select(*columns).collect()), key=repr)


def test_many_designs(spark, scope):  # noqa: F811
    facets = [X, R.Facet("z", (20,), none_in_query=True), Y]
    run, seeds = M.roll_designs, 1000
    world, states = many(spark, scope, seeds)  # noqa: F811
    got = run(world, states, facets, [0], R.Options(gone=[3], temperature=0.7, beta=0.5)).cache()
    assert got.groupBy("seed").count().filter("count <> 4").isEmpty() and got.select("seed").distinct().count() == seeds
    for s in (0, 17, 999):
        assert rows(got, s) == rows(R.roll_design(scope, facets, [0], R.Options(seed=s, gone=[3], temperature=0.7, beta=0.5)))
    world, states = many(spark, scope, 2)  # noqa: F811
    got = run(world, states, [X, Y, R.Facet("q", ())], [0, 2], R.Options(must=True, gone=[11, 12, 13]), "bare", mode_off={"bare": ["q"]}, covering=["x"], bare_item=21)
    assert rows(got, 1) == rows(R.roll_design(scope, [X, Y, R.Facet("q", ())], [0, 2], R.Options(seed=1, must=True, gone=[11, 12, 13]), "bare", mode_off={"bare": ["q"]}, covering=["x"], bare_item=21))
    assert run(*many(spark, scope, 0), [X], [0]).isEmpty()


def test_many_poses_expressions_adults(spark, scope):  # noqa: F811
    for options in (R.Options(), R.Options(must={"x"}, fixed={"y": 99}), R.Options(fixed={"x": [2], "y": ""})):
        got = M.roll_conditioned(*many(spark, scope, 3, [20]), [X, Y, R.Facet("z", (0,))], [0], options)
        assert rows(got, 2) == rows(R.roll_pose(scope, [X, Y, R.Facet("z", (0,))], [0], R.Options(seed=2, must=options.must, fixed=options.fixed), [20]))
    several = [R.Facet("x", X.pool, draws=2), Y]
    got = M.roll_conditioned(*many(spark, scope, 3), several, [0], R.Options(), top=None)
    assert rows(got, 1) == rows(R.roll_expression(scope, several, [0], R.Options(seed=1)))
    facets, strips = [R.Facet("x", X.pool, draws_by_level={2: 3}), Y, R.Facet("c", (21,), role="clothes")], {i: {"hat"} for i in X.pool}
    world, states = many(spark, scope, 4)  # noqa: F811
    acts = spark.createDataFrame([(0, 9), (20, 7)], "tid int, n long")
    got = M.roll_adults(world, M.with_acts(states, acts, 1.0), facets, R.Options(), [("hat", 20), ("shoe", 21)], strips=strips)
    for s in (0, 3):
        assert rows(got, s) == rows(R.roll_adult(lambda act: scope, facets, [(0, 9), (20, 7)], R.Options(seed=s), design=[("hat", 20), ("shoe", 21)], strips=strips))
