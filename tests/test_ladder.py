"""The ladder on a synthetic sample of 200 baskets whose results are known to six decimals."""

import numpy as np
import pytest

from coplex.plans import ladder as L

HAIR = ["black_hair", "brown_hair", "blonde_hair"]
EYES = ["blue_eyes", "red_eyes", "green_eyes"]
UPPER, LOWER = ["shirt", "serafuku"], ["skirt", "pleated_skirt"]
ONE = ["dress", "white_dress", "swimsuit", "school_uniform"]


@pytest.fixture(scope="module")
def world(spark):
    rng, rows = np.random.default_rng(7), []
    filler = [f"filler{i}" for i in range(30)]
    for b in range(200):
        tags = {"1girl", "long_hair" if rng.random() < 0.6 else "short_hair"}
        tags.add(HAIR[rng.choice(3, p=[0.5, 0.3, 0.2])])
        if rng.random() < 0.85:
            tags.add(EYES[rng.choice(3)])
        entity = 0
        if b < 60:
            entity, more = 1, ["school_uniform", "serafuku", "pleated_skirt", "thighhighs"]
        elif b < 90:
            entity, more = 2, ["dress", "white_dress", "hair_ribbon"]
        elif rng.random() < 0.5:
            more = ["dress" if rng.random() < 0.5 else "swimsuit"]
        else:
            more = ["shirt", "skirt"] + (["thighhighs"] if rng.random() < 0.4 else [])
        tags.update(more, (filler[i] for i in rng.choice(30, 28, replace=False)))
        rows.append((b, entity, sorted(tags)))
    names = sorted({t for *_, tags in rows for t in tags})
    tid = {t: i for i, t in enumerate(names)}
    data = [(b, [tid[t] for t in tags], e, len(tags)) for b, e, tags in rows]
    return spark.createDataFrame(data, "pid int, items array<smallint>, entity int, n_items int").cache(), tid


CASES = {
    "A": ([], UPPER, [200], 122, {"shirt": 0.532787, "serafuku": 0.049180}, 0.418033),
    "B": (["serafuku"], LOWER, [60, 200], 6, {"skirt": 0.522340, "pleated_skirt": 0.067824}, 0.409836),
    "C": ([ONE], UPPER, [65, 200], 65, {"shirt": 0.615989, "serafuku": 0.040422}, 0.343589),
    "D": (["black_hair", "blue_eyes"], ONE, [42, 71, 140, 200], 37, {"dress": 0.257293, "swimsuit": 0.175419, "school_uniform": 0.064935, "white_dress": 0.061968}, 0.502353),
}


@pytest.mark.parametrize("case", CASES)
def test_known_results(world, case):
    sample, tid = world
    asked, pool, sizes, n_top, shares, none_p = CASES[case]
    query = [("tag", tid[x]) if isinstance(x, str) else ("none", [tid[t] for t in x]) for x in asked]
    ids = [tid[x] for x in pool]
    for order in (query, query[::-1]):
        t = L.tiers(sample, order)
        assert t.sizes == sizes and {x.size for x in t.levels} <= set(sizes)
        found = {r["tid"]: r for r in L.ladder(t, ids).collect()}
        assert round(found[ids[0]]["n_top"]) == n_top
        assert {x: round(found[tid[x]]["p"], 6) for x in pool} == pytest.approx(shares, abs=1e-6)
        assert L.none_prob(t, ids) == pytest.approx(none_p, abs=1e-6)


def test_empty_sample(world):
    sample, tid = world
    t = L.tiers(sample.filter("pid < 0"), [("tag", tid["dress"])])
    assert t.levels == [] and L.any_ladder(t, [tid["shirt"]]) == 0
    assert L.ladder(t, [tid["shirt"]]).first()["p"] == 0


def test_levels_and_coefficients():
    assert L.step_sizes([5, 40, 120, 4000], 300) == [5, 40, 120, 4000]
    assert L.step_sizes([7], 300) == [7]
    assert L.step_sizes([33, 50, 400], 100) == [33, 400]
    assert L.kept_levels([10, 3000, 9000], 300) == 2
    n, k, base, m = [10.0, 50.0, 400.0], [3.0, 9.0, 100.0], 0.2, 300
    p = (k[2] + m * base) / (n[2] + m)
    for i in (1, 0):
        p = (k[i] + m * p) / (n[i] + m)
    c, rest = L.coefficients(n, m, True)
    assert sum(x * y for x, y in zip(c, k)) + rest * base == pytest.approx(p)
    assert L.coefficients([0.0], m, False) == ([0.0], 0.0)


def test_pair_adjust():
    cands = [(1, 0.4), (2, 0.2)]
    assert L.pair_adjust(cands, {}, [], 0.5, False) == (cands, 0.5)
    out, none_p = L.pair_adjust(cands, {(9, 1): 0.5, (9, 2): None}, [9], 0.5, False)
    assert out == [(1, 0.2), (2, 0.2)] and none_p == pytest.approx(1 - 0.5 * 0.4 / 0.6)
