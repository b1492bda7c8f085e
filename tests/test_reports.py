"""Reports over labels, news days, stress windows, simulations and tickers on rows small enough to work out by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.operators import experiments as ex
from tidemark.operators import news as nw
from tidemark.operators import regimes as rg

DAY = dt.date(2020, 1, 1)


def curve(group, symbol, closes):
    return [(group, symbol, DAY + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)]


def prices(spark, rows):
    return spark.createDataFrame(rows, "asset_group string, symbol string, ts date, close double")


def test_label_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 0), (None, 1), (1, None)], "y int, h int")
    assert {tuple(r) for r in rg.label_confusion(df, "y", "h").collect()} == {(0, 0, 2), (0, 1, 1), (1, 1, 1), (2, 0, 1)}
    r = rg.label_report(df, "y", "h").first()
    f1 = (2 / 3, 2 / 3, 0.0)
    assert (r.n, r.classes, r.accuracy, r.recall_weighted) == (5, 3, pytest.approx(0.6), pytest.approx(0.6))
    assert r.precision_weighted == pytest.approx((3 * 2 / 3 + 0.5 + 0) / 5)
    assert r.f1_weighted == pytest.approx((3 * f1[0] + f1[1] + f1[2]) / 5) and r.f1_mean == pytest.approx(sum(f1) / 3)
    assert rg.label_report(df.where("false"), "y", "h").first().n is None


def test_coverage(spark):
    bars = spark.createDataFrame([(s, DAY + dt.timedelta(days=i)) for s in "abc" for i in range(4)], "symbol string, ts date")
    news = spark.createDataFrame([("a", DAY), ("a", DAY), ("a", DAY + dt.timedelta(days=1)), ("b", DAY), ("x", DAY), (None, None)], "symbol string, ts date")
    per = nw.news_day_coverage(bars, news)
    assert {tuple(r) for r in per.collect()} == {("a", 4, 2, 50.0), ("b", 4, 1, 25.0), ("c", 4, 0, 0.0)}
    r = nw.coverage_summary(per).first()
    assert (r.tickers, r.without_news, r.mean_pct, r.median_pct, r.lowest_pct, r.highest_pct, r.range_pct) == (3, 1, 25.0, 25.0, 0.0, 50.0, 50.0)
    assert nw.coverage_summary(per.where("false")).first().tickers == 0


def test_review_and_degradation(spark):
    df = prices(spark, curve("g", "up", [100, 110, 121]) + curve("g", "deep", [100, 40, 130]) + curve("g", "down", [100, 95, 90]) + curve("h", "one", [100]))
    bench = prices(spark, curve("g", None, [100, 104, 110]) + curve("h", None, [100, 101])).drop("symbol")
    review = ex.ticker_review(df, bench, "asset_group")
    got = {r.symbol: (round(r.return_pct, 6), round(r.max_drawdown_pct, 6), round(r.excess_return_pct, 6), r.degrading, r.kept) for r in review.collect()}
    assert got["up"] == (21.0, 0.0, 11.0, False, True)
    assert got["deep"][:4] == (30.0, -60.0, 20.0, True) and got["deep"][4] is False
    assert got["down"] == (-10.0, -10.0, -20.0, True, False)
    assert got["one"] == (0.0, 0.0, -1.0, False, True)
    report = {r.asset_group: r for r in ex.degradation_report(review, ["asset_group"]).collect()}
    assert (report["g"].worst_drawdown_symbol, report["g"].names, report["g"].degrading, report["g"].excluded, round(report["g"].portfolio_impact_pct, 6)) == ("deep", 3, 2, 2, 10.0)
    assert (report["h"].degrading, report["h"].portfolio_impact_pct) == (0, 0.0)


def test_stress_report(spark):
    window = [("w", "2020-01-02", "2020-01-06"), ("none", "2021-01-01", "2021-02-01")]
    df = prices(spark, curve("g", "a", [50, 100, 90, 80, 120, 110, 7]) + curve("h", "b", [1, 2, 3, 4, 5, 6]) + curve("g", "short", [1, 2, 3]))
    bench = prices(spark, curve("g", None, [10, 10, 11, 10, 10, 11])).drop("symbol")
    got = {r.symbol: r for r in ex.stress_report(df, bench, "asset_group", window).collect()}
    assert set(got) == {"a", "b"}
    assert (round(got["a"].total_return_pct, 6), round(got["a"].max_drawdown_pct, 6), round(got["a"].bench_total_return_pct, 6), round(got["a"].excess_return_pct, 6)) == (10.0, -20.0, 10.0, 0.0)
    assert got["b"].bench_total_return_pct is None and got["b"].excess_return_pct is None


def test_simulation_summary(spark):
    rows = [("a", DAY + dt.timedelta(days=i), s, float(e)) for s, es in enumerate(([100, 90], [100, 130], [100, 105])) for i, e in enumerate(es)]
    held = spark.createDataFrame([("a", 10.0)], "symbol string, hold_return_pct double")
    r = ex.simulation_summary(spark.createDataFrame(rows, "symbol string, ts date, sim int, equity double"), held).first()
    assert (r.paths, round(r.mean_return_pct, 6), round(r.worst_return_pct, 6), round(r.best_return_pct, 6), round(r.worst_drawdown_pct, 6)) == (3, 8.333333, -10.0, 30.0, -10.0)
    assert r.losing_share == pytest.approx(1 / 3) and r.beating_share == pytest.approx(1 / 3)
