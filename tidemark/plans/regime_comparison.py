"""Flagship plan: bars → indicators → regimes → six weight sets → back-test → metrics, per universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import volatility as vol
from tidemark.operators.backtest import panel_dates, weight_backtest
from tidemark.operators.crosssection import digitize
from tidemark.operators.indicators import rogers_satchell_term
from tidemark.operators.metrics import weight_metrics
from tidemark.operators.portfolio import STRATEGY_NAMES, regime_strategy_weights
from tidemark.operators.quantiles import with_quantiles
from tidemark.operators.series import BARS, Axis, checked, pct_change, windowed
from tidemark.operators.tables import forward_fill

REGIMES = ("calm", "neutral", "stress")


def regime_frame(bars: DataFrame, per_year: Column, iv: DataFrame | None = None) -> DataFrame:
    """Per bar: return, vol, momentum and a volatility-quantile regime name of the symbol."""
    axis = checked(bars)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumns(vol.base_returns(a))
        rs = F.greatest(rogers_satchell_term(), F.lit(0.0))
        yz = F.greatest(vol.yang_zhang_variance(a, 20, rs, "overnight_return", 10), F.lit(0.0))
        return d.withColumns({
            "ret": F.col("simple_return"), "momentum": pct_change("close", a, 20),
            "vol": F.when(F.count("overnight_return").over(a.trailing(20)) >= 10, F.sqrt(per_year * yz)),
            "rv": vol.roll_std("log_return", a, 20, 10) * F.sqrt(per_year),
        })

    df = windowed(bars, add, axis, lookback=22).select("asset_group", "symbol", "ts", "close", "ret", "momentum", "vol", "rv")
    df = with_quantiles(df, "rv", [1 / 3, 2 / 3], ["symbol"], "_e", axis.hot)
    code = digitize("rv", [F.col("_e")[0], F.col("_e")[1]])
    name = F.when(code == 0, REGIMES[0]).when(code == 1, REGIMES[1]).when(code == 2, REGIMES[2])
    df = df.withColumn("regime", name).drop("_e")
    df = forward_fill(df, ["vol", "regime", "momentum"], axis)
    df = with_quantiles(df, "vol", [0.5], ["symbol"], "_median", axis.hot).withColumn("vol_median", F.col("_median")[0]).drop("_median")
    return df.withColumn("iv_spread", F.lit(None).cast("double")) if iv is None else df.join(iv, "symbol", "left")


def compare(bars: DataFrame, always_open: tuple[str, ...] = ("crypto",), cost_bps: float = 5.0, iv: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, equity) of every universe — each asset group and all assets — and strategy."""
    frame = regime_frame(bars, vol.periods_per_year(always_open=always_open), iv)
    universes = F.explode(F.array("asset_group", F.lit("all_assets")))
    weights = regime_strategy_weights(frame.withColumn("universe", universes), ["universe", "ts"])
    # the calendar comes from the bars, not from the weights, so their plan is not run twice
    days = panel_dates(bars.select(universes.alias("universe"), "ts"), ["universe"])
    perf = weight_backtest(weights, STRATEGY_NAMES, ["universe"], "ret", cost_bps, days)
    per_year = vol.periods_per_year("universe", always_open)
    return weight_metrics(perf, Axis(("universe", "strategy"), ("ts",), hot=False), per_year), perf
