"""Weights of a panel in long form.

All functions take rows of (date, symbol, ...) and normalise within ``by`` (usually the date, with the
universe in front). A group has at most one row per name, so its sums are window sums behind one
exchange, however many normalisations follow each other.
An allocator is a ``Callable[[DataFrame], DataFrame]`` that returns such rows with a weight column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, finite, ratio
from tidemark.operators.crosssection import per_group
from tidemark.operators.recurrences import ewm_mean
from tidemark.operators.frames import Frame, Frames
from tidemark.operators.series import BARS, Axis



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shares(df: DataFrame, by: Sequence[str], outputs: Mapping[str, Column | str], gross: bool = False) -> DataFrame:
    """``out = x / sum(x)`` per group (``gross``: over the sum of absolute values); empty groups give 0."""
    raw = {f"_x_{n}": F.coalesce(_c(x), F.lit(0.0)) for n, x in outputs.items()}
    df = df.withColumns(raw)
    size = (lambda n: F.sum(F.abs(f"_x_{n}"))) if gross else (lambda n: F.sum(f"_x_{n}"))
    df = per_group(df, by, {f"_s_{n}": size(n) for n in outputs})
    df = df.withColumns({n: F.coalesce(ratio(f"_x_{n}", f"_s_{n}"), F.lit(0.0)) for n in outputs})
    return df.drop(*raw, *[f"_s_{n}" for n in outputs])


def equal_weight(df: DataFrame, by: Sequence[str], eligible: Column | str, out: str) -> DataFrame:
    return shares(df, by, {out: _c(eligible).cast("double")})


def inverse_vol(df: DataFrame, by: Sequence[str], vol: str, eligible: Column, out: str) -> DataFrame:
    inv = finite(1 / F.nullif(_c(vol), F.lit(0.0)))
    return shares(df, by, {out: F.coalesce(inv, F.lit(0.0)) * eligible.cast("double")})


def risk_parity(vols: DataFrame, by: Sequence[str], vol: str, out: str) -> DataFrame:
    """Static 1/σ weights from one volatility per name."""
    return shares(vols, by, {out: 1 / F.nullif(_c(vol), F.lit(0.0))})


def vol_target(df: DataFrame, by: Sequence[str], weight: str, vol: str, target: float, cap: float, symbol: str = "symbol") -> DataFrame:
    """Scale weights to a target weighted volatility, at most ``cap`` times; a missing vol is the name's median."""
    df = per_group(df, [symbol], {"_med": F.percentile(vol, F.lit(0.5))})
    df = per_group(df, by, {"_wv": F.sum(F.abs(weight) * F.coalesce(vol, "_med"))})
    scale = F.coalesce(clip(target / F.nullif(F.col("_wv"), F.lit(0.0)), high=cap), F.lit(0.0))
    return df.withColumn(weight, F.col(weight) * scale).drop("_med", "_wv")


def tilt(df: DataFrame, by: Sequence[str], alpha: str, out: str, base: str | None = None, k: float = 0.2) -> DataFrame:
    """Demeaned, gross-normalised tilt; with ``base`` also base + k·tilt, clipped at 0 and renormalised."""
    df = per_group(df.withColumn("_a", F.coalesce(alpha, F.lit(0.0))), by, {"_m": F.avg("_a")})
    df = shares(df, by, {out: F.col("_a") - F.col("_m")}, gross=True).drop("_a", "_m")
    if base is not None:
        df = shares(df, by, {out: F.greatest(F.col(base) + k * F.col(out), F.lit(0.0))})
    return df


def capped(df: DataFrame, by: Sequence[str], alpha: str, out: str, mode: str = "ls", cap: float = 0.08, bench: str | None = None, mix: float = 0.0) -> DataFrame:
    """Long/short (``ls``) or long weights with a per-name cap, optionally mixed with a benchmark."""
    short = mode == "ls"
    if short:
        df = tilt(df, by, alpha, out)
    else:
        df = shares(df, by, {out: F.greatest(F.coalesce(alpha, F.lit(0.0)), F.lit(0.0))})
    low = -cap if short else 0.0
    df = shares(df, by, {out: clip(out, low, cap)}, gross=short)
    if mix > 0:
        blend = (1 - mix) * F.col(out) + mix * F.col(bench)
        df = shares(df, by, {out: blend if short else F.greatest(blend, F.lit(0.0))}, gross=short)
    return df


def beta_neutral(df: DataFrame, by: Sequence[str], alpha: str, beta: str, out: str, cap: float = 0.08) -> DataFrame:
    """Demeaned alpha without its projection on beta, gross-normalised, capped, normalised again."""
    df = df.withColumns({"_a": F.coalesce(alpha, F.lit(0.0)), "_b": F.coalesce(beta, F.lit(0.0))})
    df = per_group(df, by, {"_m": F.avg("_a")})
    df = df.withColumn("_x", F.col("_a") - F.col("_m"))
    df = per_group(df, by, {"_xb": F.sum(F.col("_x") * F.col("_b")), "_bb": F.sum(F.col("_b") * F.col("_b"))})
    df = df.withColumn("_y", F.col("_x") - F.col("_b") * F.coalesce(ratio("_xb", "_bb"), F.lit(0.0)))
    df = per_group(df, by, {"_my": F.avg("_y")})
    df = shares(df, by, {out: F.col("_y") - F.col("_my")}, gross=True)
    return shares(df, by, {out: clip(out, -cap, cap)}, gross=True).drop("_a", "_b", "_m", "_x", "_xb", "_bb", "_y", "_my")


def rolling_beta(ret: str, market: str, n: int = 60, least: int = 20, out: str = "beta") -> Frames:
    frames = {"_cov": Frame("covar_samp", (ret, market), n, least), "_var": Frame("var_samp", market, n, least)}
    return Frames(frames, {out: F.coalesce(finite(F.col("_cov") / F.nullif("_var", F.lit(0.0))), F.lit(0.0))})


def smoothed(df: DataFrame, by: Sequence[str], weight: str, out: str, keep: float = 0.35, axis: Axis = BARS) -> DataFrame:
    """Exponentially smoothed weights, gross-normalised per date after the smoothing.

    The smoothing runs per name; renormalising inside the recurrence would tie all names of a date
    together, so it is applied to the smoothed weights instead.
    """
    df = ewm_mean(df.withColumn("_w", F.coalesce(weight, F.lit(0.0))), {"_e": ("_w", 1 - keep, 1)}, axis)
    return shares(df, by, {out: F.col("_e")}, gross=True).drop("_w", "_e")


def limit_gross(df: DataFrame, by: Sequence[str], weight: str, out: str, most: float = 1.0, shorts: bool = True) -> DataFrame:
    """Scale a group down to a maximum gross; without shorts negative weights are 0 first."""
    w = F.coalesce(finite(weight), F.lit(0.0))
    df = df.withColumn("_w", w if shorts else F.greatest(w, F.lit(0.0)))
    df = per_group(df, by, {"_g": F.sum(F.abs("_w"))})
    scale = F.when(F.col("_g") > most, most / F.col("_g")).otherwise(1.0)
    return df.withColumn(out, F.col("_w") * scale).drop("_w", "_g")


def softmax_weights(df: DataFrame, by: Sequence[str], prediction: str, out: str, sharpness: float = 10.0) -> DataFrame:
    """exp(sharpness·p) shares, shifted by the group maximum."""
    df = per_group(df, by, {"_top": F.max(prediction)})
    return shares(df, by, {out: F.exp(sharpness * (F.col(prediction) - F.col("_top")))}).drop("_top")


def score_weights(df: DataFrame, by: Sequence[str], score: str, gate: Column, out: str, cash: str = "cash") -> DataFrame:
    """Positive standardised score as weights times a gate; what the gate leaves over is cash."""
    df = per_group(df, by, {"_m": F.avg(score), "_v": F.var_pop(score), "_n": F.count(score)})
    z = (F.col(score) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    df = df.withColumn("_p", F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)))
    df = per_group(df, by, {"_s": F.sum("_p")})
    core = F.when(F.col("_s") > 1e-8, F.col("_p") / (F.col("_s") + 1e-8)).otherwise(1 / (F.col("_n") + 1e-8))
    return df.withColumns({out: gate * core, cash: 1 - gate}).drop("_m", "_v", "_n", "_p", "_s")


def exposure(trend: Column | str, up: float, down: float) -> Column:
    return F.when(_c(trend) > 0, up).otherwise(down)


def weighted_returns(df: DataFrame, by: Sequence[str], outputs: Mapping[str, str], ret: str) -> DataFrame:
    """Portfolio return per group for several weight columns at once."""
    r = F.coalesce(ret, F.lit(0.0))
    return df.groupBy(*by).agg(*[F.sum(F.col(w) * r).alias(o) for o, w in outputs.items()])


# --- regime strategy set ---------------------------------------------------------------------

STRATEGY_NAMES = (
    "buy_hold_equal_weight", "regime_long_flat", "regime_scaled_cash", "inverse_vol_target", "momentum_filter", "iv_overlay",
)


def regime_strategy_weights(
    df: DataFrame,
    by: Sequence[str],
    target: float = 0.15,
    max_leverage: float = 1.5,
    scales: Mapping[str, float] | None = None,
    rich: float = 0.10,
    cheap: float = -0.05,
) -> DataFrame:
    """Six weight columns per (group, name) from close, vol, vol_median, regime, momentum and IV spread.

    Two rounds of group sums serve all six sets behind one exchange.
    """
    scales = scales or {"calm": 1.0, "neutral": 0.6, "stress": 0.2}
    live = F.col("close").isNotNull()
    on = live & F.coalesce(F.col("regime").isin("calm", "neutral"), F.lit(False))
    scale = F.lit(0.0)
    for name, value in scales.items():
        scale = F.when(F.col("regime") == name, value).otherwise(scale)
    spread = F.col("iv_spread")
    rv = F.when(spread < cheap, 1.25).when(spread > rich, 0.5).otherwise(1.0)
    df = df.withColumns({
        "_live": live.cast("double"), "_on": on.cast("double"), "_scale": scale, "_mult": rv,
        "_mom": (on & F.coalesce(F.col("momentum") > 0, F.lit(False))).cast("double"),
        "_inv": F.coalesce(finite(1 / F.nullif(F.col("vol"), F.lit(0.0))), F.lit(0.0)) * on.cast("double"),
    })
    df = shares(df, by, {
        "buy_hold_equal_weight": F.col("_live"), "regime_long_flat": F.col("_on"), "momentum_filter": F.col("_mom"),
        "_iv": F.col("_inv"), "_ov": F.col("_on") * F.col("_mult"),
    })
    df = df.withColumn("_cash", F.col("buy_hold_equal_weight") * F.col("_scale"))
    df = per_group(df, by, {"_wv": F.sum(F.col("_iv") * F.coalesce("vol", "vol_median")), "_gc": F.sum(F.abs("_cash"))})
    lift = F.coalesce(clip(target / F.nullif(F.col("_wv"), F.lit(0.0)), high=max_leverage), F.lit(0.0))
    return df.withColumns({
        "regime_scaled_cash": F.col("_cash") / F.greatest(F.col("_gc"), F.lit(1.0)),
        "inverse_vol_target": F.col("_iv") * lift,
        "iv_overlay": F.col("_ov"),
    }).drop("_live", "_on", "_scale", "_mult", "_mom", "_inv", "_iv", "_ov", "_cash", "_wv", "_gc")
