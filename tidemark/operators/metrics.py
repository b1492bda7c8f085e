"""Performance metrics as grouped aggregates over return and equity columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import correlation, finite, ratio
from tidemark.operators.aggregates import sample_kurtosis, sample_skew
from tidemark.operators.backtest import compound
from tidemark.operators.frames import Frame, Frames
from tidemark.operators.series import Axis, pct_change, running, windowed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def with_drawdown(df: DataFrame, equity: str, axis: Axis) -> DataFrame:
    df = running(df, {"_peak": ("max", equity)}, axis)
    return df.withColumn("drawdown", F.col(equity) / F.col("_peak") - 1).drop("_peak")


def curve_metrics(df: DataFrame, axis: Axis, equity: str = "equity", per_year: float = 252.0, bench: str | None = None, ddof_bench: int = 0) -> DataFrame:
    """Metrics of an equity curve per key; curves of fewer than two rows have zero metrics.

    The market variance behind beta uses ``ddof_bench`` (0: population variance under a sample
    covariance); Sharpe and Sortino use sample deviations and a first return of 0.
    """
    def add(d: DataFrame, a: Axis) -> DataFrame:
        new = {"_r": F.coalesce(pct_change(equity, a), F.lit(0.0))}
        if bench is not None:
            new["_b"] = F.coalesce(pct_change(bench, a), F.lit(0.0))
        return d.withColumns(new)

    df = with_drawdown(windowed(df, add, axis, lookback=1), equity, axis)
    ts = axis.order[0]
    aggs = {
        "_n": F.count(F.lit(1)), "_first": F.min_by(equity, ts), "final_equity": F.max_by(equity, ts), "_dd": F.min("drawdown"),
        "_m": F.avg("_r"), "_s": F.stddev_samp("_r"),
        "_dn": F.count_if(F.col("_r") < 0), "_ds": F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))),
    }
    if bench is not None:
        aggs |= {"_cov": F.covar_samp("_r", "_b"), "_bv": F.var_pop("_b") if ddof_bench == 0 else F.var_samp("_b"),
                 "_bm": F.avg("_b"), "_te": F.stddev_samp(F.col("_r") - F.col("_b"))}
    return curve_ratios(df.groupBy(*axis.keys).agg(*[c.alias(k) for k, c in aggs.items()]), per_year, bench is not None)


def curve_ratios(g: DataFrame, per_year: float = 252.0, bench: bool = False) -> DataFrame:
    """Metrics from a curve's rows, first and last equity, deepest drawdown and moments of its returns (``_n``, ``_first``, ...)."""
    root = per_year**0.5
    short = F.col("_n") < 2
    years = F.greatest(F.col("_n") / per_year, F.lit(0.01))
    growth = F.col("final_equity") / F.col("_first")
    down = F.when(F.col("_dn") > 1, F.col("_ds")).otherwise(F.col("_s"))
    out = {
        "total_return_pct": (growth - 1) * 100,
        "cagr_pct": (F.pow(growth, 1 / years) - 1) * 100,
        "max_drawdown_pct": F.col("_dd") * 100,
        "sharpe": ratio("_m", "_s") * root,
        "sortino": ratio(F.col("_m"), down) * root,
    }
    g = g.withColumns({k: F.when(short, 0.0).otherwise(_or_zero(c)) for k, c in out.items()})
    g = g.withColumn("calmar", _or_zero(ratio(F.col("cagr_pct"), F.abs("max_drawdown_pct"))))
    if bench:
        enough = F.col("_n") > 10
        beta = F.when(enough & (F.col("_bv") > 1e-12), F.col("_cov") / F.col("_bv")).otherwise(0.0)
        g = g.withColumn("capm_beta", beta)
        g = g.withColumns({
            "capm_alpha": F.when(enough, (F.col("_m") - F.col("capm_beta") * F.col("_bm")) * per_year * 100).otherwise(0.0),
            "info_ratio": F.when(enough, _or_zero(ratio(F.col("_m") - F.col("_bm"), "_te") * root)).otherwise(0.0),
        })
    return g.drop("_n", "_first", "_dd", "_m", "_s", "_dn", "_ds", "_cov", "_bv", "_bm", "_te")


def alpha_beta(df: DataFrame, by: Sequence[str], ret: str, market: str, per_year: float = 252.0, ddof: int = 0) -> DataFrame:
    """Annual alpha and beta with R²; fewer than 10 shared rows give zeros. ``ddof`` is the market variance's."""
    pair = F.col(ret).isNotNull() & F.col(market).isNotNull()
    var = F.var_pop if ddof == 0 else F.var_samp
    d = df.where(pair)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp(ret, market).alias("_cov"), var(market).alias("_v"),
        F.avg(ret).alias("_my"), F.avg(market).alias("_mx"), F.sum(F.col(ret) * F.col(ret)).alias("_yy"),
        F.sum(F.col(ret) * F.col(market)).alias("_xy"), F.sum(F.col(market) * F.col(market)).alias("_xx"), F.var_pop(ret).alias("_vy"),
    )
    beta = F.when(F.col("_v") > 1e-12, F.col("_cov") / F.col("_v")).otherwise(0.0)
    g = g.withColumn("beta", beta)
    # residuals are y - beta x, without an intercept
    res = F.col("_yy") - 2 * F.col("beta") * F.col("_xy") + F.col("beta") * F.col("beta") * F.col("_xx")
    tot = F.col("_vy") * F.col("n")
    few = F.col("n") < 10
    g = g.withColumns({
        "alpha_pct": (F.col("_my") - F.col("beta") * F.col("_mx")) * per_year * 100,
        "beta_return_pct": F.col("beta") * F.col("_mx") * per_year * 100,
        "r_squared": F.when(tot > 1e-12, 1 - res / tot).otherwise(0.0),
    })
    g = g.withColumn("alpha_return_pct", F.col("_my") * per_year * 100 - F.col("beta_return_pct"))
    names = ("alpha_pct", "beta", "beta_return_pct", "alpha_return_pct", "r_squared")
    return g.select(*by, *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in names])


def live_metrics(df: DataFrame, axis: Axis, equity: str, bench: str, per_year: float = 252.0) -> DataFrame:
    """Metrics annualised over n-1 steps, downside from the negative returns only, sample variances throughout."""
    def add(d: DataFrame, a: Axis) -> DataFrame:
        return d.withColumns({"_r": F.coalesce(pct_change(equity, a), F.lit(0.0)), "_b": F.coalesce(pct_change(bench, a), F.lit(0.0))})

    df = with_drawdown(windowed(df, add, axis, lookback=1), equity, axis)
    ts, root = axis.order[0], per_year**0.5
    g = df.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(equity, ts).alias("_f"), F.max_by(equity, ts).alias("_l"),
        F.min_by(bench, ts).alias("_bf"), F.max_by(bench, ts).alias("_bl"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_d"), F.min("drawdown").alias("_dd"),
        F.covar_samp("_r", "_b").alias("_cov"), F.var_samp("_b").alias("_bv"), F.avg("_b").alias("_bm"),
    )
    growth = F.col("_l") / F.col("_f")
    ann = (F.pow(growth, per_year / F.greatest(F.col("_n") - 1, F.lit(1))) - 1) * 100
    beta = F.when(F.col("_bv") > 0, F.col("_cov") / F.col("_bv")).otherwise(0.0)
    g = g.withColumns({
        "total_return_pct": (growth - 1) * 100, "annualized_return_pct": ann,
        "sharpe": _or_zero(ratio("_m", "_s") * root), "sortino": _or_zero(ratio("_m", "_d") * root),
        "max_drawdown_pct": F.col("_dd") * 100, "volatility_pct": F.coalesce(F.col("_s"), F.lit(0.0)) * root * 100,
        "bh_return_pct": (F.col("_bl") / F.col("_bf") - 1) * 100, "beta": beta,
    })
    return g.withColumns({
        "calmar": F.when(F.col("_dd") < 0, F.col("annualized_return_pct") / F.abs("max_drawdown_pct")).otherwise(0.0),
        "excess_return_pct": F.col("total_return_pct") - F.col("bh_return_pct"),
        "alpha_annualized_pct": (F.col("_m") - F.col("beta") * F.col("_bm")) * per_year * 100,
    }).drop("_n", "_f", "_l", "_bf", "_bl", "_m", "_s", "_d", "_dd", "_cov", "_bv", "_bm")


def weight_metrics(perf: DataFrame, axis: Axis, per_year: Column | float = 252.0, ret: str = "return") -> DataFrame:
    """Metrics of a weight back-test (population deviations): return, risk, turnover, cost, days."""
    py = per_year if isinstance(per_year, Column) else F.lit(float(per_year))
    d = with_drawdown(perf.withColumn("_py", py), "equity", axis)
    ts = axis.order[0]
    neg = F.when(F.col(ret) < 0, F.col(ret))
    g = d.groupBy(*axis.keys).agg(
        F.count(ret).alias("days"), F.max_by("equity", ts).alias("_l"), F.max("_py").alias("_py"), F.avg(ret).alias("_m"),
        F.stddev_pop(ret).alias("_s"), F.stddev_pop(neg).alias("_d"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"),
        F.avg("gross").alias("avg_gross"), F.sum("cost").alias("total_cost"),
    )
    root = F.sqrt("_py")
    years = F.greatest(F.col("days") / F.col("_py"), 1 / F.col("_py"))
    g = g.withColumns({
        "total_return": F.col("_l") - 1, "cagr": F.pow(F.col("_l"), 1 / years) - 1, "annual_vol": F.col("_s") * root,
        "sharpe": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * root),
        "sortino": F.when(F.col("_d") > 0, F.col("_m") / F.col("_d") * root),
    })
    return g.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown"))).drop("_l", "_py", "_m", "_s", "_d")


def compact_stats(df: DataFrame, by: Sequence[str], ret: str, per_year: float = 252.0, ddof: int = 0) -> DataFrame:
    """Total, annual return, volatility, and annual return over volatility."""
    r = F.coalesce(ret, F.lit(0.0))
    sd = F.stddev_pop(r) if ddof == 0 else F.stddev_samp(r)
    g = df.groupBy(*by).agg((F.exp(F.sum(compound(ret))) - 1).alias("total"), F.count(F.lit(1)).alias("_n"), (sd * per_year**0.5).alias("vol"))
    g = g.withColumn("annual", F.pow(1 + F.col("total"), per_year / F.col("_n")) - 1)
    return g.withColumn("sharpe", F.when(F.col("vol") > 0, F.col("annual") / F.col("vol")).otherwise(0.0)).drop("_n")


def benchmark_stats(df: DataFrame, by: Sequence[str], ret: str, bench: str, per_year: float = 252.0) -> DataFrame:
    """Tracking error, information ratio, alpha, beta, correlation and hit rate against a benchmark."""
    y, x = F.coalesce(ret, F.lit(0.0)), F.coalesce(bench, F.lit(0.0))
    active = y - x
    var = F.var_pop(x)
    beta = F.when(var > 1e-12, F.covar_pop(y, x) / var).otherwise(0.0)
    te = F.stddev_pop(active) * per_year**0.5
    return df.groupBy(*by).agg(
        te.alias("tracking_error"), F.when(te > 0, F.avg(active) * per_year / te).alias("info_ratio"), beta.alias("beta"),
        ((F.avg(y) - beta * F.avg(x)) * per_year).alias("alpha_annual"), correlation(y, x).alias("correlation"),
        F.avg(F.when(y > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def rolling_alpha_beta(ret: str, bench: str, n: int = 63, per_year: float = 252.0) -> Frames:
    full = {"least": n, "gate": "*"}
    frames = {"_var": Frame("var_pop", "_x", n, **full), "_cov": Frame("covar_pop", ("_y", "_x"), n, **full), "_my": Frame("mean", "_y", n, **full), "_mx": Frame("mean", "_x", n, **full)}
    beta = F.when(F.col("_var") > 1e-12, F.col("_cov") / F.col("_var")).otherwise(0.0)
    known = F.col("_var").isNotNull()
    outputs = {"roll_beta": F.when(known, beta), "roll_alpha": F.when(known, (F.col("_my") - beta * F.col("_mx")) * per_year)}
    return Frames(frames, outputs, {"_y": F.coalesce(ret, F.lit(0.0)), "_x": F.coalesce(bench, F.lit(0.0))})


def rolling_sharpe(ret: str, n: int = 63, per_year: float = 252.0, out: str = "roll_sharpe") -> Frames:
    return Frames({"_mean": Frame("mean", ret, n, n), "_std": Frame("std_samp", ret, n, n)}, {out: ratio(F.col("_mean"), F.col("_std")) * per_year**0.5})


def rolling_corr(a: str, b: str, n: int = 90, out: str = "roll_corr") -> Frames:
    return Frames({out: Frame("corr", (a, b), n, n)}, {out: F.col(out)})


def tail_risk(df: DataFrame, by: Sequence[str], ret: str, q: float = 0.05) -> DataFrame:
    """Value at risk, expected shortfall (mean at or below it), skew and kurtosis."""
    levels = df.groupBy(*by).agg(F.percentile(ret, F.lit(q)).alias("var"), sample_skew(ret).alias("skew"), sample_kurtosis(ret).alias("kurt"))
    joined = df.join(levels.select(*by, "var"), list(by))
    short = joined.groupBy(*by).agg(F.avg(F.when(F.col(ret) <= F.col("var"), F.col(ret))).alias("shortfall"))
    return levels.join(short, list(by))


def trade_metrics(trades: DataFrame, by: Sequence[str], pnl: str = "pnl", held: str = "bars_held") -> DataFrame:
    """Win rate, mean, profit factor and exposure over groups and their sub-totals (grouping sets)."""
    win, loss = F.when(F.col(pnl) > 0, F.col(pnl)), F.when(F.col(pnl) <= 0, F.col(pnl))
    sets = [[*by], []]
    return trades.groupingSets(sets, *by).agg(
        F.count(F.lit(1)).alias("trades"), (100 * F.avg(F.when(F.col(pnl) > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        F.avg(pnl).alias("mean_pnl"), ratio(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.sum(held).alias("bars_in_market"),
    )
