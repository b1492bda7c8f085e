from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.operators import hawkes as hk
from tidemark.operators.quantiles import exact_quantiles, with_quantiles

SHARES = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]


def data():
    rng = random.Random(6)
    rows = []
    for key, draw in (("even", rng.random), ("heavy", lambda: math.exp(rng.gauss(0, 12))), ("ties", lambda: float(rng.randrange(3))), (None, lambda: rng.gauss(0, 1)),
                      ("wide", lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300, rng.random()]))):
        rows += [(key, draw()) for _ in range(500)]
    return [*rows, ("even", None), ("even", float("nan")), ("bare", None), ("one", 4.0)]


def expected(values):
    v = sorted(values)
    out = []
    for s in SHARES:
        at = s * (len(v) - 1)
        low, high = v[math.floor(at)], v[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def check(got, values):
    assert np.allclose(got, expected(values), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("tiny_tasks", ["30", "100000"], indirect=True)
def test_groups_on_both_paths(spark, tiny_tasks):
    rows = [r for r in data() if r[0] != "wide"]
    got = {r.k: r.quantiles for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", SHARES, ["k"]).collect()}
    want = {}
    for k, x in rows:
        if x is not None and not math.isnan(x):
            want.setdefault(k, []).append(x)
    assert set(got) == set(want)
    for k, values in want.items():
        check(got[k], values)


@pytest.mark.parametrize("tiny_tasks", ["30"], indirect=True)
def test_one_group_of_extreme_values(spark, tiny_tasks):
    values = [x for k, x in data() if k == "wide"]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.5, 1.0]).first().quantiles
    assert got == [min(values), sorted(values)[249] / 2 + sorted(values)[250] / 2, max(values)]
    assert exact_quantiles(df.where("false"), "x", [0.5]).count() == 0
    assert with_quantiles(df.where("x IS NULL").unionByName(df.limit(1)), "x", [0.5]).count() == 1


@pytest.mark.parametrize("tiny_tasks", ["30"], indirect=True)
def test_large_keys_settle_at_the_same_point(spark, tiny_tasks):
    rng = np.random.default_rng(9)
    rows = [(s, int(k), float(t)) for s, n in (("a", 40), ("b", 8)) for k in (0, 1) for t in np.unique(np.round(rng.uniform(0, 200, n), 3))]
    ev = spark.createDataFrame(rows, "symbol string, kind int, t double")
    hz = spark.createDataFrame([("a", 200.0), ("b", 200.0)], "symbol string, horizon double")
    split = {r.symbol: r for r in hk.fit_bivariate(ev, hz, 1.0, tol=1e-7).collect()}
    spark.conf.set("spark.tidemark.rowsPerTask", "1000000")
    plain = {r.symbol: r for r in hk.fit_bivariate(ev.repartition(3), hz, 1.0, tol=1e-7).collect()}
    assert set(split) == set(plain) == {"a", "b"}
    for k, r in plain.items():
        assert r.settled and split[k].settled
        assert np.allclose([r[p] for p in hk.PARAMS], [split[k][p] for p in hk.PARAMS], atol=1e-5)
