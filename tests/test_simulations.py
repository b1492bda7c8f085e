"""Paths on arrays give what a row per path gives."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import noise
from tidemark.operators import experiments as ex


def close_rows(found, wanted, names, digits=6):
    key = lambda r: tuple(str(r[c]) for c in names)
    a, b = sorted(found.collect(), key=key), sorted(wanted.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for c in found.columns:
            same = x[c] == y[c] if not isinstance(x[c], float) or y[c] is None else math.isclose(x[c], y[c], rel_tol=10.0**-digits, abs_tol=10.0**-digits)
            assert same, (c, x, y)


@pytest.fixture()
def bars(spark):
    rng, out = np.random.default_rng(2), []
    for key, n in (("a", 130), ("b", 1), ("c", 2), (None, 9), ("a rather long name of a symbol, too long for one block", 12)):
        for t in range(n):
            out.append((key, None if t == 0 and key in ("a", "c") else t, None if key == "a" and t in (7, 8, 50) else 100 + float(rng.normal())))
            if key == "a" and t in (20, 21, 129):
                out += [out[-1]] * 2
    df = spark.createDataFrame(out, "symbol string, ts int, close double")
    return df.withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (100 - F.col("close")) * 2)))


@pytest.mark.parametrize("at_once", [13, 500, 200_000])
def test_bands_and_metrics_equal_those_of_rows(spark, bars, at_once):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        sim = dataclasses.replace(ex.simulation(bars, "signal", 13), at_once=at_once)
        rows = ex.monte_carlo(bars, "signal", 13)
        close_rows(ex.percentile_bands(sim, ["symbol", "ts"]), ex.percentile_bands(rows, ["symbol", "ts"]), ["symbol", "ts"])
        held = bars.groupBy("symbol").agg(F.lit(0.5).alias("hold_return_pct"))
        close_rows(ex.simulation_summary(sim, held), ex.simulation_summary(rows, held), ["symbol"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("key", ["7", "", "a name that fills a block of sixty-four bytes together with its numbers"])
def test_noise_on_arrays_is_the_noise_of_columns(spark, key):
    first, second = np.array([0, 3, 9, 10, 42, 199, 1000]), np.arange(95, 103)
    df = spark.createDataFrame([(int(i), int(j)) for j in second for i in first], "i int, j long").coalesce(1)
    wanted = np.array([r[0] for r in df.select(noise.normal(5, F.lit(key), "i", "j")).collect()]).reshape(len(second), len(first))
    assert np.allclose(noise.normals(5, f":{key}", first, second), wanted, rtol=1e-12, atol=1e-12)
    assert noise.plain_uniform(5, 42, salt="delay") == spark.range(1).select(noise.uniform(5, F.lit(42), salt="delay")).first()[0]


@pytest.mark.parametrize("name", ["monte_carlo_bands", "monte_carlo_summary"])
def test_no_row_per_path(spark, folder, name):
    """a row per path and bar was hashed, sorted and grouped."""
    text = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in text and "percentile" not in text and "MapInArrow" in text


@pytest.mark.parametrize("at_once", [40, 131_072])
def test_grid_scores_equal_those_of_rows(spark, bars, at_once, monkeypatch):
    points, axis = ex.grid(fast=[2, 3], slow=[5, 9]), ex.Axis(("symbol",), ("ts",))
    rows = ex.score_curves(ex.sma_grid_curves(bars, points, axis), axis)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        grid = ex.Grid(bars, points, axis, 5.0, at_once)
        found = ex.curve_ratios(grid.curves()).withColumn("score", F.col("sharpe"))
        # a curve that stands still returns nothing but rounding, the sign of which decides what counts as a loss in sortino
        rows = rows.drop("sortino")
        close_rows(found.select(*rows.columns), rows, ["symbol", "fast", "slow"])
        assert "sortino" in found.columns and ex.grid_scores(bars, points, axis).columns == found.columns
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folds_are_scored_once(spark, bars):
    """training and test parts were scored apart, with a row per point, and joined; a hot series still takes rows."""
    folded = ex.expanding_folds(bars.dropna(), 3, min_train=10, min_test=5)
    points = ex.grid(fast=[2, 3], slow=[5, 9])
    found = ex.optimise_folds(folded, points)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("MapInArrow") == 1
    scores = ex.score_curves(ex.sma_grid_curves(folded, points, ex.BARS.within("fold", "role")), ex.BARS.within("fold", "role"))
    best = ex.best_point(scores.where("role = 'train'"), ["symbol", "fold"]).withColumnRenamed("score", "train_sharpe")
    test = scores.where("role = 'test'").select("symbol", "fold", "fast", "slow", F.col("sharpe").alias("test_sharpe"), F.col("total_return_pct").alias("test_return_pct"),
                                              F.col("max_drawdown_pct").alias("test_max_dd_pct"))
    wanted = best.join(test, ["symbol", "fold", "fast", "slow"])
    close_rows(found, wanted.select(*found.columns), ["symbol", "fold"])
