"""Realised volatility blocks, surfaces and event flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, finite, ratio, safe_log_ratio
from tidemark.operators.frames import Frame, Frames
from tidemark.operators.indicators import (
    _annual,
    gains,
    garman_klass_term,
    losses,
    parkinson_term,
    rogers_satchell_term,
    strength,
    true_range,
    yang_zhang_mix,
    yang_zhang_variance,
)
from tidemark.operators.passes import Deviations, Means, Part, of_frames, with_parts
from tidemark.operators.recurrences import span, wilder
from tidemark.operators.series import (
    BARS,
    Axis,
    log_return,
    pct_change,
    prev,
    roll_max,
    roll_mean,
    roll_quantile,
    roll_std,
    windowed,
)


def periods_per_year(group: str = "asset_group", always_open: Sequence[str] = ("crypto",)) -> Column:
    """365 for markets that never close, else 252."""
    return F.when(F.lower(group).isin([g.lower() for g in always_open]), F.lit(365.0)).otherwise(F.lit(252.0))


def base_returns(axis: Axis) -> dict[str, Column]:
    """Returns and log ranges of a bar."""
    before = prev("close", axis)
    lr = log_return("close", axis)
    return {
        "log_return": lr,
        "simple_return": pct_change("close", axis),
        "abs_return": F.abs(lr),
        "squared_return": lr * lr,
        "overnight_return": F.when((F.col("open") > 0) & (before > 0), F.log(F.col("open") / before)),
        "intraday_return": safe_log_ratio("close", "open"),
        "hl_log_range": safe_log_ratio("high", "low"),
        "oc_log_range": safe_log_ratio("close", "open"),
        "ho_log_range": safe_log_ratio("high", "open"),
        "lo_log_range": safe_log_ratio("low", "open"),
    }


def vol_block(n: int, per_year: Column) -> Frames:
    """Five estimators over ``n`` bars; null until max(5, n/2) bars are known."""
    least = max(5, n // 2)
    inputs = {"_pk": parkinson_term(), "_gk": clip(garman_klass_term(), low=0.0), "_rs": clip(rogers_satchell_term(), low=0.0), "_day": safe_log_ratio("close", "open")}
    frames = {f"_{kind}_{c}_{n}": Frame(kind, c, n, least) for kind, c in (
        ("std_samp", "log_return"), ("mean", "_pk"), ("mean", "_gk"), ("mean", "_rs"), ("var_samp", "overnight_return"), ("var_samp", "_day"))}
    close, pk, gk, rs, night, day = (F.col(c) for c in frames)
    return Frames(frames, {
        f"rv_close_{n}": close * F.sqrt(per_year),
        f"rv_parkinson_{n}": _annual(pk, per_year),
        f"rv_garman_klass_{n}": _annual(gk, per_year),
        f"rv_rogers_satchell_{n}": _annual(rs, per_year),
        f"rv_yang_zhang_{n}": _annual(clip(yang_zhang_mix(night, day, rs, n), low=0.0), per_year),
    }, inputs)


def event_levels(n: int = 60, q: float = 0.9) -> Frames:
    """What the event flags compare: the standardised return and the quantile of absolute returns."""
    least = max(20, n // 2)
    mean, std, level = (f"_{k}_{n}" for k in ("mean", "std", "level"))
    frames = {mean: Frame("mean", "log_return", n, least), std: Frame("std_samp", "log_return", n, least), level: Frame("quantile", "abs_return", n, least, q)}
    return Frames(frames, {f"return_z_{n}": ratio(F.col("log_return") - F.col(mean), F.col(std)), f"abs_return_q_{n}": F.col(level)})


def add_events(df: DataFrame, n: int = 60, z: float = 2.25) -> DataFrame:
    """Jump (standardised return) and high-volatility (rolling quantile) flags from ``event_levels``."""
    jump = F.coalesce(F.abs(f"return_z_{n}") >= z, F.lit(False))
    high = F.coalesce(F.col("abs_return") >= F.col(f"abs_return_q_{n}"), F.lit(False))
    return df.withColumns({"jump_event": jump, "high_vol_event": high, "event_flag": (jump | high).cast("int")})


def drawdown_from_peak(n: int = 60, source: str = "close", out: str = "drawdown_60") -> Frames:
    return Frames({"_peak": Frame("max", source, n, 2)}, {out: F.col(source) / F.col("_peak") - 1})


def volume_z(n: int = 20, least: int = 10, out: str = "volume_z_20") -> Frames:
    frames = {"_volume_mean": Frame("mean", "volume", n, least), "_volume_std": Frame("std_samp", "volume", n, least)}
    return Frames(frames, {out: finite(ratio(F.col("volume") - F.col("_volume_mean"), F.col("_volume_std")))})


def market_indicators(
    bars: DataFrame,
    axis: Axis = BARS,
    windows: Sequence[int] = (10, 20, 60),
    per_year: Column | None = None,
) -> DataFrame:
    """All bar-level volatility indicators and event flags of every symbol in one plan."""
    per_year = periods_per_year() if per_year is None else per_year

    def inputs(a: Axis) -> dict[str, Column]:
        return {**base_returns(a), "true_range": true_range(a), "momentum_20": pct_change("close", a, 20), "_gain": gains("close", a), "_loss": losses("close", a)}

    rsi = wilder(14)
    steps = [Means({"atr_14": ("true_range", wilder(14), 14), "_ag": ("_gain", rsi, 1), "_al": ("_loss", rsi, 1)}), Deviations({"_ew": ("log_return", span(20), 10)})]
    outputs = {"ewma_vol_20": F.col("_ew") * F.sqrt(per_year), "atr_pct_14": ratio("atr_14", "close"), "rsi_14": strength("_ag", "_al")}
    frames = of_frames(drawdown_from_peak(), volume_z(), *[vol_block(n, per_year) for n in windows], event_levels())
    return add_events(with_parts(bars, axis, Part(inputs, steps, outputs, lookback=20), frames))


def realised_surface(df: DataFrame, axis: Axis, windows: Sequence[int], last: int, per_year: float = 252.0) -> DataFrame:
    """Long (time, window, vol) surface; bars before the longest window are dropped, then the last ones kept.

    ``df`` carries ``rn`` (0-based position in the series) and ``n_rows``.
    """
    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_lr", log_return("close", a))
        return d.withColumns({f"w{n}": roll_std("_lr", a, n) * F.sqrt(F.lit(per_year)) for n in windows})

    wide = windowed(df, add, axis, lookback=max(windows) + 1)
    wide = wide.where((F.col("rn") >= max(windows)) & (F.col("rn") >= F.col("n_rows") - last))
    entries = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"w{n}").alias("vol")) for n in windows])
    return wide.select(*axis.keys, *axis.order, F.explode(entries).alias("e")).select(
        *axis.keys, *axis.order, "e.window", "e.vol"
    )
