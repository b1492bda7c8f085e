from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import series, signals
from tidemark.operators.recurrences import ewm_mean, ewm_std
from tidemark.operators.series import Axis, has_hot_key, number_rows, running, scan, windowed


def frame(spark, n=300, seed=1, nulls=True):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.6, "hot", "cold"), "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "x": rng.normal(size=n)})
    if nulls:
        pdf.loc[rng.random(n) < 0.15, "x"] = np.nan
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), pdf


def test_number_rows_counts_up(spark, tiny_tasks):
    df, pdf = frame(spark)
    assert has_hot_key(df, Axis())
    got = number_rows(df.repartition(7), Axis()).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        assert g["rn"].tolist() == list(range(len(g)))


def check_ewm(df, pdf):
    out = ewm_std(ewm_mean(df, {"m": ("x", 0.2, 3)}), "s", "x", 0.2, 4).toPandas().sort_values(["symbol", "ts"])
    for key, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol"):
        mine = out[out["symbol"] == key]
        np.testing.assert_allclose(mine["m"].astype(float), g["x"].ewm(alpha=0.2, adjust=False, min_periods=3).mean(), rtol=1e-9)
        np.testing.assert_allclose(mine["s"].astype(float), g["x"].ewm(alpha=0.2, adjust=False, min_periods=4).std(), rtol=1e-9)


def test_exponential_moments_follow_pandas(spark):
    check_ewm(*frame(spark))


def test_exponential_moments_in_blocks(spark, tiny_tasks):
    check_ewm(*frame(spark, seed=3))


def test_partition_count_does_not_matter(spark):
    df, _ = frame(spark, seed=5)
    one = windowed(df.coalesce(1), lambda d, a: d.withColumn("m", F.avg("x").over(a.trailing(7))), lookback=6)
    many = windowed(df.repartition(11), lambda d, a: d.withColumn("m", F.avg("x").over(a.trailing(7))), lookback=6)
    key = lambda d: sorted(map(tuple, d.select("symbol", "ts", F.round("m", 9)).collect()), key=str)
    assert key(one) == key(many)


def test_running_kinds_in_blocks(spark, tiny_tasks):
    df, pdf = frame(spark, seed=9)
    out = running(df, {"s": ("sum", "x"), "n": ("count", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "last": ("last", "x"), "first": ("first", "x")})
    out = out.toPandas().sort_values(["symbol", "ts"])
    for key, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol"):
        mine = out[out["symbol"] == key]
        x = g["x"].reset_index(drop=True)
        np.testing.assert_allclose(mine["s"].astype(float), x.cumsum().ffill(), rtol=1e-9)
        np.testing.assert_array_equal(mine["n"], x.notna().cumsum())
        np.testing.assert_allclose(mine["hi"].astype(float), x.cummax().ffill())
        np.testing.assert_allclose(mine["lo"].astype(float), x.cummin().ffill())
        np.testing.assert_allclose(mine["last"].astype(float), x.ffill())
        np.testing.assert_allclose(mine["first"].astype(float).dropna().unique(), [x.dropna().iloc[0]])


def test_scan_that_never_forgets_settles(spark, tiny_tasks):
    df, pdf = frame(spark, n=200, seed=11, nulls=False)

    def step(p, state):
        total = (state[0] if state else 0.0) + p["x"].cumsum().to_numpy()
        return {"c": total}, [float(total[-1])]

    out = scan(df, step, "c double").toPandas().sort_values(["symbol", "ts"])
    for key, g in pdf.sort_values(["symbol", "ts"]).groupby("symbol"):
        np.testing.assert_allclose(out[out["symbol"] == key]["c"], g["x"].cumsum(), rtol=1e-9)


def test_no_look_ahead(spark, folder):
    """Cutting the future off must not change past rows."""
    from tidemark.operators import indicators as ind
    from tidemark.sources import bindings as b

    bars = b.bars(spark, folder)
    cut = bars.where(F.col("ts") < "1999-01-01")
    full = ind.core_summary(bars).where(F.col("ts") < "1999-01-01").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    part = ind.core_summary(cut).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(full, part)


@pytest.mark.parametrize("tiny_tasks", ["11", "100000"], indirect=True)
def test_machines_equal_a_loop(spark, tiny_tasks):
    rng = random.Random(3)
    rows = [(k, t, [rng.randrange(4) for _ in range(4)], [rng.randrange(2) for _ in range(2)]) for k, n in (("a", 70), (None, 33), ("b", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts long, m array<int>, o array<int>").repartition(3)
    got = {(r.symbol, r.ts): (r.x, r.y) for r in series.machines(df, {"x": (F.col("m"), 2), "y": (F.col("o"), 0)}).collect()}
    state = {}
    for k, t, m, o in rows:
        x, y = state.get(k, (2, 0))
        state[k] = m[x], o[y]
        assert got[k, t] == state[k]
    assert len(got) == len(rows)


@pytest.mark.parametrize("tiny_tasks", ["7", "100000"], indirect=True)
def test_cooldowns_equal_a_loop(spark, tiny_tasks):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < 0.4, rng.random() < 0.2) for k in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, rn long, up boolean, down boolean").repartition(4)
    got = {(r.symbol, r.rn): (r.u, r.d) for r in signals.cooldown(df, {"u": "up", "d": "down"}, {"u": 1, "d": 5}).collect()}
    one = {(r.symbol, r.rn): r.signal for r in signals.exclusive_cooldown(df, "up", "down", 4).collect()}
    last = {}
    for k, i, up, down in rows:
        want = []
        for name, flag, wait in (("u", up, 1), ("d", down, 5), ("one", up or down, 4)):
            keep = flag and i - last.get((k, name), -99) >= wait
            if keep:
                last[k, name] = i
            want.append(keep)
        assert got[k, i] == tuple(want[:2])
        assert one[k, i] == ((1.0 if up else -1.0) if want[2] else 0.0)
