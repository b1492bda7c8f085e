"""Session-reset running values, calendar-time windows and bar-derived proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, ratio
from tidemark.operators.crosssection import per_group
from tidemark.operators.recurrences import ewm_mean, span
from tidemark.operators.series import (
    BARS,
    Axis,
    checked,
    has_hot_key,
    largest_key,
    pct_change,
    prev,
    roll_max,
    roll_mean,
    roll_std,
    running,
    windowed,
)


def anchored_vwap(df: DataFrame, axis: Axis = BARS, session: str = "day", price: str = "close", bands: int = 3,
                  prefix: str = "vwap") -> DataFrame:
    """Volume-weighted price anchored at the session start, deviation bands and percent distance."""
    within = axis.within(session)
    df = running(df, {"_pv": ("sum", F.col(price) * F.col("volume")), "_v": ("sum", "volume")}, within)
    df = df.withColumn(prefix, ratio("_pv", "_v")).withColumn("_dev", F.col(price) - F.col(prefix))
    # a session holds a bounded number of bars, so the expanding deviation runs inside it
    sd = F.coalesce(F.stddev_samp("_dev").over(within.so_far()), F.lit(0.0))
    df = df.withColumn("_sd", sd)
    df = df.withColumns({
        **{f"{prefix}_upper_{k}": F.col(prefix) + k * F.col("_sd") for k in range(1, bands + 1)},
        **{f"{prefix}_lower_{k}": F.col(prefix) - k * F.col("_sd") for k in range(1, bands + 1)},
        f"{prefix}_distance_pct": 100 * ratio(F.col(price) - F.col(prefix), prefix),
    })
    return df.drop("_pv", "_v", "_dev", "_sd")


def tick_direction(axis: Axis) -> Column:
    before = prev("close", axis)
    return F.when(F.col("close") > before, 1).when(F.col("close") < before, -1).otherwise(0)


def volume_delta(df: DataFrame, axis: Axis = BARS, look: int = 10, session: str = "day") -> DataFrame:
    """Tick-rule cumulative volume delta per session, its z-score and the defended-bar flags."""
    df = windowed(df, lambda d, a: d.withColumn("_dv", tick_direction(a) * F.col("volume")), axis, lookback=1)
    df = running(df, {"cumulative_delta": ("sum", "_dv")}, axis.within(session)).drop("_dv")

    def add(d: DataFrame, a: Axis) -> DataFrame:
        n = look * 5
        sd = roll_std("cumulative_delta", a, n, 1)
        sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        z = (F.col("cumulative_delta") - roll_mean("cumulative_delta", a, n, 1)) / sd
        return d.withColumn("cd_zscore", F.coalesce(z, F.lit(0.0)))

    df = windowed(df, add, axis, lookback=look * 5)
    return df.withColumns({
        "dh_green_bar": (F.col("cd_zscore") > 1.5) & (F.col("close") > F.col("vwap")),
        "dh_red_bar": (F.col("cd_zscore") < -1.5) & (F.col("close") < F.col("vwap")),
        "dh_intensity": clip(F.abs("cd_zscore"), 0.0, 5.0) * 2,
    })


def sensitivity_proxies(df: DataFrame, axis: Axis | None = None, delta: int = 10, gamma: int = 10, vanna: int = 20) -> DataFrame:
    """Momentum (delta), its change (gamma) and its co-movement with volatility changes (vanna)."""
    axis = axis or checked(df)
    df = windowed(
        df,
        lambda d, a: d.withColumns({
            "delta_proxy": F.coalesce(pct_change("close", a, delta), F.lit(0.0)),
            "_ret": F.coalesce(pct_change("close", a), F.lit(0.0)),
        }),
        axis, lookback=delta,
    )
    df = ewm_mean(df, {"delta_smooth": ("delta_proxy", span(delta), 1)}, axis)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        top = roll_max(F.abs("delta_smooth"), a, 2 * delta, 1)
        norm = clip(F.col("delta_smooth") / F.when(top == 0, F.lit(0.001)).otherwise(top), -1.0, 1.0)
        d = d.withColumns({
            "delta_norm": F.coalesce(norm, F.lit(0.0)),
            "gamma_raw": F.coalesce(F.col("delta_smooth") - prev("delta_smooth", a), F.lit(0.0)),
            "_vol": roll_std("_ret", a, vanna, 5),
        })
        sd = roll_std("gamma_raw", a, 2 * gamma, 1)
        g = clip(F.col("gamma_raw") / F.when(sd == 0, F.lit(0.0001)).otherwise(sd), -3.0, 3.0)
        d = d.withColumn("gamma_norm", F.coalesce(g, F.lit(0.0)))
        return d.withColumns({
            "gamma_magnitude": roll_mean(F.abs("gamma_norm"), a, gamma, 1),
            "vanna_proxy": F.coalesce(F.col("delta_norm") * (F.col("_vol") - prev("_vol", a)), F.lit(0.0)),
        })

    return windowed(df, add, axis, lookback=2 * delta + 2 * gamma + vanna).drop("_ret", "_vol")


def state_features(df: DataFrame, look: int = 20, axis: Axis | None = None) -> DataFrame:
    """Normalised signal, volatility, deviation and trend of a bar."""
    axis = axis or checked(df)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_ret", pct_change("close", a))
        d = d.withColumns({
            "signal": F.coalesce(roll_mean("_ret", a, look), F.lit(0.0)),
            "vol": clip(F.coalesce(roll_std("_ret", a, look), F.lit(0.0)), 0.0, 0.05),
        })
        d = d.withColumn("kl", F.coalesce(roll_mean(F.abs(F.col("_ret") - F.col("signal")), a, 3), F.lit(0.0)))
        trend = (F.col("close") - roll_mean("close", a, look)) / (roll_std("close", a, look) + 1e-6)
        return d.withColumns({
            "signal_norm": F.tanh(F.col("signal") * 10),
            "kl_norm": F.tanh(F.col("kl") * 20),
            "price_trend": F.coalesce(F.tanh(trend), F.lit(0.0)),
        })

    df = windowed(df, add, axis, lookback=look + 5)
    df = per_group(df, axis.keys, {"_top": F.max("vol")}, axis.hot)
    return df.withColumn("vol_norm", F.col("vol") / (F.col("_top") + 1e-6)).drop("_ret", "_top")


def lagged_returns(df: DataFrame, axis: Axis) -> DataFrame:
    """Yesterday's return and its short and long mean, deviation and size."""
    df = df.withColumn("_r", pct_change("close", axis)).withColumn("ret_lag", prev("_r", axis))
    return df.withColumns({
        "mean_5": roll_mean("ret_lag", axis, 5, 2),
        "std_5": roll_std("ret_lag", axis, 5, 2),
        "mean_20": roll_mean("ret_lag", axis, 20, 5),
        "std_20": roll_std("ret_lag", axis, 20, 5),
        "abs_20": roll_mean(F.abs("ret_lag"), axis, 20, 5),
    }).drop("_r")


def _days_frame(axis: Axis, days: int):
    return Window.partitionBy(*axis.keys).orderBy("_t").rangeBetween(-days * 86400, 0)


def _rows_within(df: DataFrame, days: int, axis: Axis) -> int:
    """Rows that a window of ``days`` can reach back: the most crowded day of a series, times the days it touches.

    Counted only where a key is too large for a task; elsewhere nothing is copied and the number does not matter.
    """
    if not has_hot_key(df, axis):
        return days
    return largest_key(df.withColumn("_day", F.to_date(axis.order[0])), [*axis.keys, "_day"]) * (days + 1)


def trailing_days(df: DataFrame, days: int, source: str, least: int = 5, axis: Axis = BARS) -> DataFrame:
    """Deviation and row count over a calendar-time window ending at the row."""
    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_t", F.unix_timestamp(F.col(a.order[0]).cast("timestamp")))
        w = _days_frame(a, days)
        return d.withColumns({
            f"vol_{days}d": F.when(F.count(source).over(w) >= least, F.stddev_samp(source).over(w)),
            f"rows_{days}d": F.count(F.lit(1)).over(w),
        }).drop("_t")

    return windowed(df, add, axis, lookback=_rows_within(df, days, axis))


def padded_days(df: DataFrame, days: int, source: str, length: int, axis: Axis = BARS) -> DataFrame:
    """The values of a calendar-time window as an array, edge-padded to ``length``."""
    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_t", F.unix_timestamp(F.col(a.order[0]).cast("timestamp")))
        d = d.withColumn("seq", F.collect_list(source).over(_days_frame(a, days))).withColumn("n_seq", F.size("seq"))
        missing = F.greatest(F.lit(length) - F.col("n_seq"), F.lit(0))
        return d.withColumn("seq", F.concat("seq", F.array_repeat(F.element_at("seq", -1), missing))).drop("_t")

    return windowed(df, add, axis, lookback=_rows_within(df, days, axis))
