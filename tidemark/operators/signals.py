"""Trading signals: column in, column out, plus the stateful rules on the ``scan`` primitive.

A strategy is any ``Callable[[DataFrame], DataFrame]`` that adds a ``signal`` column in [-1, 1]; use it
with ``DataFrame.transform``. ``STRATEGIES`` names the ready ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, ratio
from tidemark.operators.crosssection import pct_rank, per_group
from tidemark.operators.frames import Frame, framed
from tidemark.operators.microstructure import liquidity_capture, structure_break
from tidemark.operators.recurrences import ewm_mean, span
from tidemark.operators.series import BARS, Axis, checked, machines, pct_change, positions, prev, roll_mean, roll_std, windowed
from tidemark.operators.tables import with_group_size


def rank_of_last(source: str, n: int, least: int | None = None) -> Frame:
    """Share of the last ``n`` rows strictly below the current one; null rows stay in the denominator."""
    return Frame("share_below", source, n, n, gate="*") if least is None else Frame("share_below", source, n, least)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# --- single-series rules ---------------------------------------------------------------------


def sma_cross(axis: Axis, fast: int = 20, slow: int = 100) -> Column:
    return _zero((roll_mean("close", axis, fast) > roll_mean("close", axis, slow)).cast("double"))


def mean_reversion(df: DataFrame, axis: Axis | None = None, look: int = 50, enter: float = 1.5, leave: float = 0.3) -> DataFrame:
    """Contrarian position with hysteresis: opened at ±enter, closed once z is back inside ±leave."""
    axis = axis or checked(df)
    df = windowed(
        df, lambda d, a: d.withColumn("_z", _zero(ratio(F.col("close") - roll_mean("close", a, look), roll_std("close", a, look)))),
        axis, lookback=look,
    )

    z = F.col("_z")
    # states: 0 flat, 1 long, 2 short
    moves = F.array(F.when(z <= -enter, 1).when(z >= enter, 2).otherwise(0), F.when(z >= -leave, 0).otherwise(1), F.when(z <= leave, 0).otherwise(2))
    held = machines(df, {"signal": (moves, 0)}, axis).drop("_z")
    return held.withColumn("signal", F.when(F.col("signal") == 2, -1.0).otherwise(F.col("signal").cast("double")))


def _clock(flag: str, bars: int):
    """Moves of a clock that runs up to ``bars`` rows; 0 is a row that is kept, which takes a full clock."""
    def moves(pdf):
        passed = np.clip(np.arange(bars + 1) + pdf["_gap"].to_numpy(dtype=np.int64)[:, None], 1, bars)
        wanted = pdf[flag].fillna(False).to_numpy(dtype=bool)[:, None]
        return np.where(wanted & (passed >= bars), 0, passed)

    return moves


def cooldown(df: DataFrame, flags: Mapping[str, str], bars: int | Mapping[str, int], axis: Axis = BARS, pos: str = "rn") -> DataFrame:
    """Keep a flag only if the last kept one is at least ``bars`` rows back.

    ``flags`` maps output → input boolean column; each output has its own clock (and, with a mapping,
    its own length). Only rows where some
    input is set enter the machine; the others get false by the join back.
    """
    names = list(flags)
    wait = [bars[n] if isinstance(bars, Mapping) else bars for n in names]
    active = None
    for source in flags.values():
        active = F.col(source) if active is None else (active | F.col(source))
    sparse = df.where(active).select(*axis.keys, pos, *set(flags.values()))
    order = checked(sparse, Axis(axis.keys, (pos,)))
    timed = windowed(sparse, lambda d, a: d.withColumn("_gap", F.col(pos) - F.coalesce(prev(pos, a), F.col(pos))), order, lookback=1)
    kept = machines(timed, {f"_k_{n}": (_clock(flags[n], w), w) for n, w in zip(names, wait, strict=True)}, order)
    kept = kept.select(*axis.keys, pos, *[(F.col(f"_k_{n}") == 0).alias(n) for n in names])
    return df.join(kept, [*axis.keys, pos], "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def exclusive_cooldown(df: DataFrame, long: str, short: str, bars: int, axis: Axis = BARS, pos: str = "rn") -> DataFrame:
    """One clock for both directions: +1/-1 on kept rows, long first, else 0."""
    both = df.withColumn("_any", F.col(long) | F.col(short))
    kept = cooldown(both, {"_kept": "_any"}, bars, axis, pos).drop("_any")
    side = F.when(F.coalesce(F.col(long), F.lit(False)), 1.0).otherwise(-1.0)
    return kept.withColumn("signal", F.when(F.col("_kept"), side).otherwise(0.0)).drop("_kept")


def vwap_reversion(df: DataFrame, bars: int = 10, lower: str = "vwap_lower_2", upper: str = "vwap_upper_2") -> DataFrame:
    """Buy below the lower band, sell above the upper one, one signal per cooldown."""
    no = F.lit(False)
    df = positions(df).withColumns({
        "_long": F.coalesce(F.col("close") < F.col(lower), no), "_short": F.coalesce(F.col("close") > F.col(upper), no),
    })
    return exclusive_cooldown(df, "_long", "_short", bars).drop("_long", "_short", "rn")


def institutional(df: DataFrame, look: int = 20, recover: int = 5, wick: float = 0.0008, least: float = 0.0005,
                  threshold: float = 70.0, bars: int = 20, tolerance: float = 1.5, axis: Axis | None = None) -> DataFrame:
    """Liquidity sweep + structure break + price near VWAP, scored 30/30/20, with a cooldown.

    Reads ``recover`` bars ahead by definition (``lookahead``); do not trade it as it stands.
    """
    axis = axis or checked(df)
    df = positions(df, axis)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = swept_levels(d, a, look, recover, wick)
        d = structure_break(d, a, look, least)
        w = a.trailing(2 * look)
        near = F.when(F.abs("vwap_distance_pct") < tolerance, 20).otherwise(0)
        pts = {}
        for side, name in (("long", "bullish"), ("short", "bearish")):
            had = F.max(F.col(f"liq_capture_{side}").cast("int")).over(w) > 0
            pts[side] = F.when(had, 30).otherwise(0) + F.when(F.col(f"msb_{name}_valid"), 30).otherwise(0) + near
        ripe = F.col("rn") >= 2 * look
        before = prev("close", a)
        return d.withColumns({
            "_long": F.coalesce(ripe & (pts["long"] >= threshold) & (F.col("close") > before), F.lit(False)),
            "_short": F.coalesce(ripe & (pts["short"] >= threshold) & (F.col("close") < before), F.lit(False)),
        })

    df = windowed(df, add, axis, lookback=4 * look, lookahead=recover + 1)
    return exclusive_cooldown(df, "_long", "_short", bars, axis).drop("_long", "_short")


def swept_levels(df: DataFrame, axis: Axis, look: int, recover: int, wick: float) -> DataFrame:
    """Sweep flags whose recovery looks at the next ``recover`` closes against the swept level."""
    from tidemark.operators.series import roll_max, roll_min

    w = axis.rows(1, recover)
    full = F.count(F.lit(1)).over(w) >= recover
    for side, roll, extreme, sign in (("long", roll_min, "low", 1), ("short", roll_max, "high", -1)):
        swing = roll(extreme, axis, look)
        df = df.withColumn("_swing", swing)
        level, older, was = prev("_swing", axis), prev("_swing", axis, 2), prev(extreme, axis)
        broke = (sign * (F.col(extreme) - level) < 0) & F.coalesce(sign * (was - older) >= 0, F.lit(False))
        deep = sign * (level - F.col(extreme)) > level * wick
        reach = F.max("close").over(w) if side == "long" else F.min("close").over(w)
        back = full & (sign * (reach - level) > 0)
        df = df.withColumn(f"liq_capture_{side}", F.coalesce(broke & deep & back, F.lit(False)))
    return df.drop("_swing")


def _router_inputs(df: DataFrame, axis: Axis, vol_n: int, mom_n: int, rev_n: int) -> DataFrame:
    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_ret", _zero(pct_change("close", a)))
        return d.withColumns({
            "_vol": roll_std("_ret", a, vol_n),
            "_rev": -F.signum(roll_mean("_ret", a, rev_n)),
            "_mom": F.signum(roll_mean("_ret", a, mom_n)),
        })

    return windowed(df, add, axis, lookback=max(vol_n, mom_n, rev_n) + 1)


def _train_threshold(df: DataFrame, axis: Axis, percentile: float, train: float) -> DataFrame:
    """Volatility threshold from the first ``train`` share of each series (median of all when too short)."""
    df = with_group_size(positions(df, axis), list(axis.keys), "_n", axis.hot)
    df = df.withColumn("_tv", F.when(F.col("rn") < F.floor(F.col("_n") * F.lit(train)), F.col("_vol")))
    df = per_group(df, axis.keys, {
        "_k": F.count("_tv"), "_q": F.percentile("_tv", F.lit(percentile / 100)), "_med": F.percentile("_vol", F.lit(0.5)),
    }, axis.hot)
    level = F.when(F.col("_k") < 20, F.col("_med")).otherwise(F.col("_q"))
    return df.withColumn("_level", level).drop("_n", "rn", "_tv", "_k", "_q", "_med")


def regime_router(df: DataFrame, vol_n: int = 20, percentile: float = 50.0, mom_n: int = 5, rev_n: int = 1,
                  train: float = 0.7, axis: Axis | None = None) -> DataFrame:
    """High volatility fades the last move, low volatility follows momentum. Adds ``direction`` and ``signal``."""
    axis = axis or checked(df)
    df = _train_threshold(_router_inputs(df, axis, vol_n, mom_n, rev_n), axis, percentile, train)
    high = F.coalesce((F.col("_vol") >= F.col("_level")).cast("double"), F.lit(0.0))
    direction = high * F.col("_rev") + (1 - high) * F.col("_mom")
    return df.withColumns({"direction": direction, "signal": clip(_zero(direction), -1.0, 1.0)}).drop("_ret", "_rev", "_mom", "_level")


def intensity_gated(df: DataFrame, gate: str = "hard", percentile: float = 70.0, vol_n: int = 20, axis: Axis | None = None, **router) -> DataFrame:
    """Router signal gated by the whole-sample rank of smoothed volatility (looks at the full sample)."""
    axis = axis or checked(df)
    df = regime_router(df, vol_n=vol_n, axis=axis, **router)
    df = windowed(df, lambda d, a: d.withColumn("_i", roll_mean("_vol", a, vol_n)), axis, lookback=vol_n)
    df = pct_rank(df, "_i", axis.keys, "_rank", axis.hot)
    share = (F.col("_rank") >= percentile / 100).cast("double") if gate == "hard" else soft_gate(F.col("_rank"))
    return df.withColumn("signal", clip(_zero(share * F.col("direction")), -1.0, 1.0)).drop("_i", "_rank")


def hard_gate_ewm(df: DataFrame, percentile: float = 70.0, vol_n: int = 20, look: int = 252, least: int = 20, axis: Axis | None = None, **router) -> DataFrame:
    """Router signal gated by the trailing rank of exponentially smoothed volatility."""
    axis = axis or checked(df)
    df = regime_router(df, vol_n=vol_n, mom_n=router.pop("mom_n", 3), axis=axis, **router)
    df = ewm_mean(df, {"_i": ("_vol", span(vol_n), 1)}, axis)
    df = windowed(df, lambda d, a: framed(d, {"_rank": rank_of_last("_i", look, least)}, a), axis, lookback=look)
    share = _zero((F.col("_rank") >= percentile / 100).cast("double"))
    return df.withColumn("signal", clip(_zero(share * F.col("direction")), -1.0, 1.0)).drop("_i", "_rank")


def delayed(signal: str, axis: Axis, bars: int) -> Column:
    return F.lag(signal, bars, 0.0).over(axis.spec())


def regime_signal(regime: Column | str) -> Column:
    """Calm long, neutral flat, stress short."""
    r = F.col(regime) if isinstance(regime, str) else regime
    return F.when(r == "calm", 1.0).when(r == "stress", -1.0).otherwise(0.0)


# --- cross-sectional gates and directions ----------------------------------------------------


def hard_gate(rank: Column, q: float) -> Column:
    return _zero((rank >= q).cast("double"))


def soft_gate(rank: Column) -> Column:
    return clip(2 * clip(rank - 0.5, low=0.0), high=1.0)


def acceleration(df: DataFrame, intensity: str, axis: Axis = BARS, ts: str = "ts") -> DataFrame:
    """Change of intensity, standardised across names, positive part."""
    df = windowed(df, lambda d, a: d.withColumn("_d", _zero(F.col(intensity) - prev(intensity, a))), axis, lookback=1)
    df = per_group(df, [ts], {"_m": F.avg("_d"), "_s": F.stddev_samp("_d")})
    z = _zero(ratio(F.col("_d") - F.col("_m"), F.col("_s")))
    return df.withColumn("accel", F.greatest(z, F.lit(0.0))).drop("_d", "_m", "_s")


def directions(df: DataFrame, known: str, axis: Axis = BARS, ts: str = "ts") -> DataFrame:
    """Reversal, momentum signs (3, 5, 10, 20), residual reversal and their mixes from known returns."""
    df = per_group(df, [ts], {"_mkt": F.avg(known)})

    def add(d: DataFrame, a: Axis) -> DataFrame:
        r = F.col(known)
        mean = {n: roll_mean(known, a, n, m) for n, m in ((3, 2), (5, 3), (10, 5), (20, 10))}
        return d.withColumns({
            "rev1": _zero(-F.signum(r)),
            **{f"mom{n}": _zero(F.signum(m)) for n, m in mean.items()},
            "resid_rev": _zero(-F.signum(r - F.col("_mkt"))),
            "mom_mix": _zero(F.signum(0.6 * mean[5] + 0.4 * mean[10])),
        })

    return windowed(df, add, axis, lookback=20).drop("_mkt")


def signal_family(rank: Column, regime: Column, accel: Column) -> dict[str, Column]:
    """Four gate-by-direction signals; ``regime`` is 1 in high volatility."""
    rev, calm = F.col("rev1"), 1 - regime
    return {
        "s1_hard70_mom3_rev": hard_gate(rank, 0.70) * (regime * rev + calm * F.col("mom3")),
        "s2_soft_mom5_rev": _zero(soft_gate(rank)) * (regime * rev + calm * F.col("mom5")),
        "s3_accel_mom10_rev": accel * (regime * rev + calm * F.col("mom10")),
        "s4_hard65_mom5_flat": hard_gate(rank, 0.65) * (calm * F.col("mom5")),
    }


def sleeves(intensity: Column, vol: Column, beta: Column, trend: Column, conviction: Column) -> dict[str, Column]:
    """Membership filters from percentile ranks (trend is a level)."""
    yes = lambda c: _zero(c.cast("double"))
    return {
        "all": F.lit(1.0), "high_intensity": yes(intensity >= 0.5), "low_intensity": yes(intensity < 0.5),
        "low_vol": yes(vol <= 0.5), "high_vol": yes(vol > 0.5), "low_beta": yes(beta <= 0.5), "high_beta": yes(beta > 0.5),
        "positive_trend": yes(trend > 0), "top_conviction_30": yes(conviction >= 0.7),
    }


# --- investor profiles -----------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    max_position: float = 1.0
    max_leverage: float = 1.0
    vol_target: float = 0.0
    signal_clip: float = 1.0
    vol_lookback: int = 20

    def shape(self, signal: Column | str) -> Column:
        """Clip to conviction and position limits, then scale or cap by leverage."""
        limit = min(self.signal_clip, self.max_position)
        s = clip(signal, -limit, limit)
        if self.max_leverage < 1:
            return s * self.max_leverage
        return clip(s * self.max_leverage, -self.max_leverage, self.max_leverage) if self.max_leverage > 1 else s

    def vol_scale(self, ret: str, axis: Axis, pos: Column) -> Column:
        """Target volatility over the deviation of the returns before this bar, within 0.1–3."""
        if self.vol_target <= 0:
            return F.lit(1.0)
        w = axis.rows(-self.vol_lookback, -1)
        sd = F.stddev_samp(ret).over(w)
        ready = (pos >= self.vol_lookback) & (F.count(F.lit(1)).over(w) >= 5) & (sd >= 1e-8)
        return F.when(ready, clip(self.vol_target / sd, 0.1, 3.0)).otherwise(1.0)


# fixed values: the three preset profiles
PROFILES = {
    "conservative": Profile(max_position=0.5, max_leverage=0.8, vol_target=0.10, signal_clip=0.5),
    "moderate": Profile(max_position=0.75, max_leverage=1.0, vol_target=0.15, signal_clip=0.75),
    "aggressive": Profile(max_position=1.0, max_leverage=1.5, vol_target=0.25, signal_clip=1.0),
}

Strategy = Callable[[DataFrame], DataFrame]


def _window_strategy(**params) -> Strategy:
    def run(df: DataFrame) -> DataFrame:
        return windowed(df, lambda d, a: d.withColumn("signal", sma_cross(a, **params)), lookback=params.get("slow", 100))

    return run


STRATEGIES: dict[str, Callable[..., Strategy]] = {
    "sma_cross": _window_strategy,
    "mean_reversion": lambda **p: lambda df: mean_reversion(df, **p),
    "vwap_reversion": lambda **p: lambda df: vwap_reversion(df, **p),
    "institutional": lambda **p: lambda df: institutional(df, **p),
    "regime_router": lambda **p: lambda df: regime_router(df, **p),
    "intensity_gated": lambda **p: lambda df: intensity_gated(df, **p),
    "hard_gate_ewm": lambda **p: lambda df: hard_gate_ewm(df, **p),
}


def strategy(name: str, **params) -> Strategy:
    """A named strategy with its parameters bound."""
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name](**params)


# --- intraday entry rules --------------------------------------------------------------------


def opening_breakout(axis: Axis, side: str, bars: int = 6) -> Column:
    """Close beyond the opening range, once the range is complete."""
    edge = prev("orb_high" if side == "long" else "orb_low", axis)
    beyond = F.col("close") > edge if side == "long" else F.col("close") < edge
    return F.coalesce(beyond & (F.col("session_bar") > bars), F.lit(False))


def entry_rules(df: DataFrame, allowed: Column, axis: Axis | None = None) -> DataFrame:
    """Five rule pairs over session columns, each with its own cooldown: ``entry_<rule>_<side>``.

    Expects VWAP bands, cumulative delta, opening range, and momentum proxies on the rows.
    """
    from tidemark.operators.microstructure import delta_divergence, gap_flags

    axis = axis or checked(df)
    df = positions(df, axis)
    rules = ("vwap_reversion", "opening_range", "gap_fill", "delta_divergence", "vwap_pullback")

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = delta_divergence(gap_flags(d, a), a)
        far, near = F.col("vwap_distance_pct"), F.abs("vwap_distance_pct") < 0.3
        before = prev("close", a)
        w = a.trailing(10)
        enough = F.count(F.lit(1)).over(w) >= 5
        up = enough & (F.max(((far > 1.5) & (F.col("delta_norm") > 0.2)).cast("int")).over(w) > 0)
        down = enough & (F.max(((far < -1.5) & (F.col("delta_norm") < -0.2)).cast("int")).over(w) > 0)
        raw = {
            "vwap_reversion": (F.col("close") < F.col("vwap_lower_2"), F.col("close") > F.col("vwap_upper_2")),
            "opening_range": (opening_breakout(a, "long"), opening_breakout(a, "short")),
            "gap_fill": (F.col("gap_down") & (F.col("session_bar") > 1), F.col("gap_up") & (F.col("session_bar") > 1)),
            "delta_divergence": (F.col("bull_div"), F.col("bear_div")),
            "vwap_pullback": (up & near & (F.col("close") > before), down & near & (F.col("close") < before)),
        }
        sides = {}
        for name in rules:
            for side, c in zip(("long", "short"), raw[name]):
                sides[f"_{name}_{side}"] = F.coalesce(c & allowed, F.lit(False))
        return d.withColumns(sides)

    df = windowed(df, add, axis, lookback=70)
    # fixed values: cooldown bars per rule
    waits = dict(zip(rules, (10, 10, 10, 30, 20)))
    flags = {f"entry_{n}_{s}": f"_{n}_{s}" for n in rules for s in ("long", "short")}
    df = cooldown(df, flags, {f"entry_{n}_{s}": waits[n] for n in rules for s in ("long", "short")}, axis)
    return df.drop(*[f"_{n}_{s}" for n in rules for s in ("long", "short")])
