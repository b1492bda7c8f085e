"""Rows that made queries fail or grow faster than their input."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import experiments as ex
from tidemark.operators import learning as ml
from tidemark.operators import microstructure as ms
from tidemark.operators import options as op
from tidemark.operators import signals as sg
from tidemark.operators import spectra as sp
from tidemark.operators.backtest import target_backtest
from tidemark.operators.series import BARS, ROWS_PER_TASK, scan
from tidemark.sources import bindings as b


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def walk(spark, days=120, keys=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    return bars_of(spark, [(k, c, c, c, c, 1) for k in keys for c in 100 + rng.normal(size=days).cumsum()])


def bars_of(spark, rows):
    """(symbol, open, high, low, close, volume) per day, numbered days."""
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(s, day + dt.timedelta(i), *map(float, r)) for i, (s, *r) in enumerate(rows)], "symbol string, ts date, open double, high double, low double, close double, volume double")


def test_levels_of_zero(spark):
    """Prices of 0 are levels like others: a close above a high of 0 is a break of full strength."""
    df = bars_of(spark, [("a", 0, 0, 0, 0, 1)] * 30 + [("a", 0, 5, 0, 4, 1)] * 30).withColumn("vwap_distance_pct", F.lit(0.0))
    out = ms.structure_break(ms.liquidity_capture(df, BARS), BARS).orderBy("ts").collect()
    assert [r["msb_bullish"] for r in out[:32]] == [False] * 30 + [True, False]
    # the fall below a swing level of 0 sweeps it wholly
    low = bars_of(spark, [("a", 1, 1, 0, 1, 1)] * 30 + [("a", 1, 1, -1, 1, 1)] + [("a", 1, 1, 0, 1, 1)] * 10)
    swept = ms.liquidity_capture(low, BARS).orderBy("ts").collect()
    assert [i for i, r in enumerate(swept) if r["liq_capture_long"]] == [30] and swept[30]["liq_quality_long"] == 1.0
    assert sg.institutional(df).count() == 60


def test_components_always_end(spark):
    """A feature that is not finite ended the singular value routine behind the components without a result."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    rows = [[float(v) for v in r] + [float(r[0] - r[3])] for r in x] + [[float("inf")] + [0.0] * 6]
    df = spark.createDataFrame(rows, ", ".join([f"x{i} double" for i in range(6)] + ["y double"]))
    cols = [f"x{i}" for i in range(6)]
    model = ml.fit_regression(df, cols, "y", ml.penalised("ridge", 1e-6), components=6)
    q = ml.fit_quality(ml.predict(model, df.where(F.col("x0") < 1e300)), [], "y", "prediction").first()
    assert q["n"] == 200 and q["r2"] > 0.999
    vectors = df.select(F.array(*cols).alias("v"))
    out, shares, axes = ml.pca(vectors, "v", 3)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(axes.T @ want[2][:3].T), np.eye(3), atol=1e-6) and np.allclose(shares, (want[1] ** 2 / (want[1] ** 2).sum())[:3])
    assert out.where(F.size("pc") == 3).count() == 201


def test_fractal_windows_are_not_exploded(spark):
    df = walk(spark)
    for f in (lambda: sp.rolling_fractal(df, "close", [50, 100], 20), lambda: sp.fractal(df, "close", ["symbol"])):
        plain = f()
        assert "Generate" not in plan_of(plain)
        spark.conf.set(ROWS_PER_TASK, "40")
        try:
            split = f()
            assert "Generate" in plan_of(split)
            cols = [c for c in split.columns]
            show = lambda d: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect())
            assert show(plain) == show(split)
        finally:
            spark.conf.unset(ROWS_PER_TASK)
    flat = bars_of(spark, [("c", *[0.1] * 4, 1)] * 60)
    assert sp.fractal(flat, "close", ["symbol"]).collect()[0][1:] == (None, None, None, None)


def test_rows_that_all_trade_need_no_join(spark):
    df = walk(spark, 60).withColumn("signal", F.sin("close"))
    odd = df.union(df.where("day(ts) = 7")).union(df.limit(1).withColumn("ts", F.lit(None).cast("date")))
    own = target_backtest(odd, BARS, trade=None)
    assert "Join" not in plan_of(own)
    joined = target_backtest(odd.withColumn("trades_now", F.lit(True)), BARS).drop("trades_now")
    # rows of one key and time come in any order, so their running volume is not compared
    show = lambda d: sorted((r["symbol"], str(r["ts"]), round(r["equity"], 6)) for r in d.collect())
    assert show(own) == show(joined)
    assert "Join" not in plan_of(ex.sma_grid_curves(df, ex.grid(fast=[5], slow=[20]), BARS))


def test_fan_out_is_spread(spark):
    df = walk(spark, 60).withColumn("signal", F.lit(0.5))
    spark.conf.set(ROWS_PER_TASK, "100")
    try:
        assert ex.monte_carlo(df, "signal", 20).rdd.getNumPartitions() >= 120 * 20 // 100
        assert ex.expanding_folds(df, 3, min_train=10, min_test=5).rdd.getNumPartitions() >= 120 * ex.FOLD_FAN // 100
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_steps_get_what_they_need(spark):
    seen = lambda pdf, state: ({"k": [float(len(pdf.columns))] * (len(pdf) - 1) + [float("nan")]}, [0.0])
    out = scan(walk(spark, 3, ("a",)), seen, "k double", needs=["close"]).orderBy("ts").collect()
    assert [r["k"] for r in out] == [1.0, 1.0, None] and str(out[0]["ts"]) == "2020-01-01"


def test_quotes_are_priced_in_many_tasks(spark, folder):
    q = b.option_quotes(spark, folder)
    assert q.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    rows = [("call", 100.0, 90.0, 0.5, 0.2), ("put", 100.0, 120.0, 0.25, 0.4), (None, None, 90.0, 0.5, 0.2), ("call", 0.0, 90.0, 0.5, 0.2)]
    df = spark.createDataFrame(rows, "kind string, spot double, strike double, tau double, vol double")
    quote = [F.col(c) for c in ("kind", "spot", "strike", "tau")]
    priced = df.withColumn("price", op.black_scholes(*quote, F.col("vol"), 0.03, 0.01))
    out = priced.withColumn("iv", op.implied_vol(F.col("price"), *quote, 0.03, 0.01)).collect()
    assert [r["iv"] and round(r["iv"], 4) for r in out] == [0.2, 0.4, None, None]
    assert "lambda" not in plan_of(priced.withColumn("iv", op.implied_vol(F.col("price"), *quote)))
