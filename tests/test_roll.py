"""Rolls on a synthetic world: what each module does beside asking and drawing."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from coplex import queries as Q
from coplex.plans import roll as R

NAMES = {0: "anchor", **{i: f"x{i}" for i in range(1, 7)}, **{i: f"y{i}" for i in range(11, 15)}, 20: "umbrella", 21: "bare"}
X, Y = R.Facet("x", tuple(range(1, 7))), R.Facet("y", tuple(range(11, 15)))


@pytest.fixture(scope="module")
def scope(spark):
    rows = []
    for p in range(400):
        items = [0, 1 + p % 6] + ([11 + p % 4] if p % 3 else []) + ([1 + (p + 1) % 6] if p % 5 == 0 else []) + ([20, 21] if p % 2 else [])
        rows.append((p, sorted(set(items)), 0, len(set(items))))
    sample = spark.createDataFrame(rows, "pid int, items array<smallint>, entity int, n_items int").cache()
    rates = sample.select(F.explode("items").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n")).cache()
    one = sample.select("pid", F.explode("items").alias("tid"))
    pairs = one.withColumnRenamed("tid", "a").join(one.withColumnRenamed("tid", "b"), "pid").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).cache()
    return R.Scope(sample, rates, 400, NAMES, pairs=pairs, singles=rates, pair_total=400, well=2)


def tags(df, facet=None):
    return [(r.status, r.tag) for r in df.orderBy("ord", "draw").collect() if facet in (None, r.facet)]


def test_small_samples_are_smoothed(scope):
    wide = scope.sample
    small = R.Scope.of(scope.sample, lambda: wide, scope.rates, 400, NAMES)
    assert small.prior is wide
    assert R.Scope.of(scope.sample, lambda: 1 / 0, scope.rates, 400, NAMES, m=10).prior is None


def stub(scope):
    """What queries take their scopes from, all samples the same."""
    own = lambda *a, **k: scope.sample
    sizes = {"n_all": 400, "n_e": 400, "pair_total": 400}
    return SimpleNamespace(sample=own, wide=own, coded=own, rates=lambda rating: scope.rates, constants=sizes, names=NAMES, index=SimpleNamespace(table=lambda name: scope.pairs))


def test_samples_of_a_segment_are_smoothed_whatever_their_size(scope, monkeypatch):
    monkeypatch.setattr(R, "is_small", lambda *a: False)
    found = Q._scope(stub(scope), 0, segments=4)
    assert found.prior is not None and found.lift_of is not None
    assert Q._scope(stub(scope), 0).prior is None


def test_samples_of_an_act_are_smoothed_whatever_their_size(scope, monkeypatch):
    monkeypatch.setattr(R, "is_small", lambda *a: False)
    assert Q._scope(stub(scope), 0, "e", 3).prior is not None


def test_design(scope):
    facets = [X, Y, R.Facet("z", (20,), none_in_query=True), R.Facet("w", (21,))]
    run = lambda *a, **k: R.roll_design(scope, facets, [0, 3], *a, **k)
    found = tags(run(R.Options(seed=5, fixed={"y": 14, "w": ""}), default_off=["z"]))
    assert found == [("anchor", "anchor"), ("anchor", "x3"), ("fixed", "y14"), ("off", None), ("fixed", None)]
    assert tags(run(R.Options(seed=5, must=True, gone=[11, 12, 13]), "bare", mode_off={"bare": ["w"]}, covering=["x"], bare_item=21), "y") == [("drawn", "y14")]
    assert run(R.Options(seed=5)).collect() == run(R.Options(seed=5)).collect()
    picks = {tags(R.roll_design(scope, [X], [0], R.Options(seed=s, must={"x"})), "x")[0][1] for s in range(6)}
    assert len(picks) > 1 and None not in picks
    none_p = R.roll_design(scope, [Y], [0]).filter("facet = 'y'").first().none_p
    assert none_p == pytest.approx(1 / 3, abs=0.01)  # a third of the baskets lack y
    none = R.roll_design(scope, [R.Facet("q", ())], [0], R.Options(must=True)).filter("facet = 'q'").first()
    assert none.status == "no candidates" and none.tag is None


def test_beta_weighs_draws():
    a = R.Answer(1, 1, [(1, 0.5, 0.1, 1), (2, 0.5, 10.0, 1)], 0.0)
    drawn = [R._draw(a, R.Options(seed=s, beta=1.0), "f", 0, False) for s in range(60)]
    assert drawn.count(2) > 50
    assert {R._draw(a, R.Options(seed=s), "f", 0, False, [1]) for s in range(9)} == {2}


def test_adult(scope):
    facets = [R.Facet("x", X.pool, draws_by_level={1: 1, 2: 3}), R.Facet("y", Y.pool, draws_by_level={1: 0}), R.Facet("c", (21,), role="clothes")]
    run = lambda **k: R.roll_adult(lambda act: scope, facets, [(0, 9), (20, 1)], **k)
    found = run(act=0, options=R.Options(seed=2, must={"x"}), level=2, bare=True, design=[("hat", 20), ("shoe", 21)], strips={i: {"hat"} for i in X.pool})
    assert len({t for _, t in tags(found, "x")}) == 3
    assert tags(found, "hat") == [("stripped", "umbrella")] and tags(found, "shoe") == [("kept", "bare")] and tags(found, "c") == [("off", None)]
    assert tags(run(act=0, level=1), "y") == [("drawn", None)]
    assert {run(options=R.Options(seed=s), level=1).first().tag for s in range(8)} <= {"anchor", "umbrella"}
    assert tags(run(act=0, options=R.Options(fixed={"x": [2, 99]})), "x") == [("fixed", "x2")]


def test_scene(scope):
    facets = [R.Facet("frame", Y.pool, role="frame"), R.Facet("bg", X.pool, role="background", solid=X.pool, umbrella=20), R.Facet("place", (), fallback=(21,))]
    run = lambda **k: R.roll_scene(scope, facets, [0], wide=lambda: scope.sample, **k)
    found = run(background="simple", frame=12, options=R.Options(seed=1, must={"place"}))
    assert tags(found, "frame") == [("fixed", "y12")] and tags(found, "bg_umbrella") == [("added", "umbrella")] and tags(found, "place") == [("drawn", "bare")]
    assert 1 <= len(tags(found, "bg")) <= R.BACKGROUNDS and found.filter("facet = 'bg'").first().none_p is None
    assert tags(run(background="real", frame="off"), "bg") == [("off", None)] and tags(run(background="real", frame="off"), "frame") == [("off", None)]
    assert tags(run(options=R.Options(fixed={"bg": [2, 3]})), "bg") == [("fixed", "x2"), ("fixed", "x3")]
    assert "x1" not in {t for s in range(6) for _, t in tags(run(removed=[1], background="simple", options=R.Options(seed=s, on={"bg"})), "bg")}


def test_pose_and_expression(scope):
    found = R.roll_pose(scope, [X, Y], [0, 2, 3], R.Options(seed=3, fixed={"y": ""}), [20])
    assert tags(found) == [("anchor", "x2"), ("fixed", None)]
    several = R.roll_expression(scope, [R.Facet("x", X.pool, draws=2), Y], [0], R.Options(seed=3, must={"x"}, fixed={"y": [13]}))
    assert len(set(tags(several, "x"))) == 2 and tags(several, "y") == [("fixed", "y13")]
    assert tags(R.roll_expression(scope, [Y], [0], R.Options(fixed={"y": [99]}))) == [("fixed", None)]
    drawn = R.roll_pose(scope, [Y], [0], R.Options(fixed={"y": 99}, must=True)).first()
    assert drawn.tag in {NAMES[i] for i in Y.pool}  # an unknown fixed item falls through to a draw


def test_chain(scope):
    seen = []

    def module(facet):
        def roll(before):
            seen.append(before)
            return R.roll_pose(scope, [facet], [0], R.Options(seed=4, must=True), before)

        return roll

    found = R.roll_chain([("one", module(X)), ("two", module(Y)), ("three", module(R.Facet("z", (20,))))], {v: k for k, v in NAMES.items()})
    drawn = [r.tag for r in found.orderBy("number").collect()]
    assert seen[0] == [] and [NAMES[x] for x in seen[2]] == drawn[:2] and found.columns[:2] == ["number", "module"]
