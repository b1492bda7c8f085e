"""Technical indicators as columns over a series axis.

Functions named after an indicator return column expressions (``Column`` or a dict of them) that are
valid inside ``series.windowed``; ``add_*`` functions take and return a DataFrame and are used where a
recurrence is involved. ``LOOKBACK`` tells how many earlier rows the window-only block can reach.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, ratio, safe_log_ratio
from tidemark.operators.frames import Frame
from tidemark.operators.passes import Made, Means, Part, Trailing, over, where, with_parts
from tidemark.operators.recurrences import ewm_mean, span, wilder
from tidemark.operators.series import (
    BARS,
    Axis,
    log_return,
    pct_change,
    prev,
    roll_max,
    roll_mean,
    roll_min,
    roll_std,
    roll_sum,
    roll_var,
    windowed,
)


TINY = 1e-12  # padding of the denominators in the plain-mean variants


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- moving averages -------------------------------------------------------------------------


def sma(source, axis: Axis, n: int) -> Column:
    return roll_mean(source, axis, n)


def wma(source, axis: Axis, n: int) -> Column:
    """Linearly weighted mean over a full frame; the newest row has weight n."""
    w = axis.trailing(n)
    values = F.collect_list(_c(source)).over(w)
    weighted = F.aggregate(
        F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda total, x: total + x
    )
    return F.when(F.count(_c(source)).over(w) >= n, weighted / (n * (n + 1) / 2.0))


def hma_inputs(source, axis: Axis, n: int) -> Column:
    return 2 * wma(source, axis, max(n // 2, 1)) - wma(source, axis, n)


def add_hma(df: DataFrame, axis: Axis, n: int, name: str, source: str = "close") -> DataFrame:
    """Weighted-mean form: WMA(sqrt n) of 2*WMA(n/2) - WMA(n). A period below 2 is the series itself."""
    if n < 2:
        return df.withColumn(name, _c(source))
    return df.withColumn("_raw", hma_inputs(source, axis, n)).withColumn(name, wma("_raw", axis, max(isqrt(n), 1))).drop("_raw")


def add_hma_sma(df: DataFrame, axis: Axis, n: int, name: str, source: str = "close") -> DataFrame:
    """Plain-mean form of the same construction; a different function with a similar name."""
    raw = 2 * roll_mean(source, axis, n // 2) - roll_mean(source, axis, n)
    return df.withColumn("_raw", raw).withColumn(name, roll_mean("_raw", axis, isqrt(n))).drop("_raw")


def vwma(close, volume, axis: Axis, n: int) -> Column:
    return roll_sum(_c(close) * _c(volume), axis, n) / roll_sum(volume, axis, n)


# --- momentum --------------------------------------------------------------------------------


def gains(source, axis: Axis) -> Column:
    return clip(_c(source) - prev(source, axis), low=0.0)


def losses(source, axis: Axis) -> Column:
    return clip(prev(source, axis) - _c(source), low=0.0)


def strength(gain, loss) -> Column:
    """100 - 100/(1+gain/loss); zero loss gives null."""
    return 100 - 100 / (1 + ratio(gain, loss))


def add_rsi(df: DataFrame, axis: Axis = BARS, n: int = 14, name: str = "rsi", gated: bool = True) -> DataFrame:
    """Wilder-smoothed relative strength; ``gated=False`` reports from the first difference on."""
    least = n if gated else 1
    moved = windowed(
        df, lambda d, a: d.withColumns({"_gain": gains("close", a), "_loss": losses("close", a)}), axis, lookback=1
    )
    smooth = ewm_mean(moved, {"_ag": ("_gain", wilder(n), least), "_al": ("_loss", wilder(n), least)}, axis)
    return smooth.withColumn(name, strength("_ag", "_al")).drop("_gain", "_loss", "_ag", "_al")


def add_rsi_simple(df: DataFrame, axis: Axis, n: int = 14, name: str = "rsi_simple") -> DataFrame:
    """Relative strength over plain rolling means; the denominator is padded instead of nulled."""
    d = df.withColumns({"_gain": gains("close", axis), "_loss": losses("close", axis)})
    rs = roll_mean("_gain", axis, n) / (roll_mean("_loss", axis, n) + TINY)
    return d.withColumn(name, 100 - 100 / (1 + rs)).drop("_gain", "_loss")


def stochastic_k(axis: Axis, n: int = 14) -> Column:
    low, high = roll_min("low", axis, n), roll_max("high", axis, n)
    return 100 * ratio(_c("close") - low, high - low)


def add_stochastic(df: DataFrame, axis: Axis, n: int = 14, smooth: int = 1, d: int = 3) -> DataFrame:
    """%K (optionally smoothed) and %D."""
    df = df.withColumn("_k", stochastic_k(axis, n))
    df = df.withColumn("stoch_k", roll_mean("_k", axis, smooth) if smooth > 1 else _c("_k"))
    return df.withColumn("stoch_d", roll_mean("stoch_k", axis, d)).drop("_k")


def williams_r(axis: Axis, n: int = 14) -> Column:
    low, high = roll_min("low", axis, n), roll_max("high", axis, n)
    return -100 * ratio(high - _c("close"), high - low)


def momentum(source, axis: Axis, n: int = 10) -> Column:
    return _c(source) - prev(source, axis, n)


def roc(source, axis: Axis, n: int = 10) -> Column:
    return 100 * pct_change(source, axis, n)


def cci(axis: Axis, n: int = 20, typical: str = "_tp") -> Column:
    """Needs ``typical`` = (high+low+close)/3; mean absolute deviation comes from the frame itself."""
    return ratio(_c(typical) - roll_mean(typical, axis, n), 0.015 * mean_abs_deviation(typical, axis, n))


def mean_abs_deviation(source, axis: Axis, n: int) -> Column:
    w = axis.trailing(n)
    frame = F.collect_list(_c(source)).over(w)
    start = F.struct(F.avg(_c(source)).over(w).alias("mean"), F.lit(0.0).alias("total"))
    total = F.aggregate(
        frame,
        start,
        lambda s, x: F.struct(s["mean"].alias("mean"), (s["total"] + F.abs(x - s["mean"])).alias("total")),
        lambda s: s["total"],
    )
    return F.when(F.count(_c(source)).over(w) >= n, total / n)


def awesome(axis: Axis, fast: int = 5, slow: int = 34) -> Column:
    mid = (_c("high") + _c("low")) / 2
    return roll_mean(mid, axis, fast) - roll_mean(mid, axis, slow)


def add_ultimate(df: DataFrame, axis: Axis, short: int = 7, medium: int = 14, long: int = 28, name: str = "ultimate") -> DataFrame:
    before = prev("close", axis)
    df = df.withColumns({
        "_bp": _c("close") - F.least("low", before),
        "_tr": F.greatest("high", before) - F.least("low", before),
    })
    part = {n: ratio(roll_sum("_bp", axis, n), roll_sum("_tr", axis, n)) for n in (short, medium, long)}
    return df.withColumn(name, 100 * (4 * part[short] + 2 * part[medium] + part[long]) / 7).drop("_bp", "_tr")


def ichimoku_base(axis: Axis, n: int = 26) -> Column:
    return (roll_max("high", axis, n) + roll_min("low", axis, n)) / 2


# --- range and bands -------------------------------------------------------------------------


def true_range(axis: Axis) -> Column:
    before = prev("close", axis)
    return F.greatest(_c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before))


def atr_simple(axis: Axis, n: int = 14, tr: str = "tr") -> Column:
    return roll_mean(tr, axis, n)


def add_atr(df: DataFrame, axis: Axis = BARS, n: int = 14) -> DataFrame:
    """Wilder average true range and its share of the close (percent)."""
    return with_parts(df, axis, atr_part(n))


def atr_part(n: int = 14) -> Part:
    return Part(lambda a: {"tr": true_range(a)}, [Means({"atr": ("tr", wilder(n), n)})], {"natr": 100 * ratio("atr", "close")})


def atr_simple_part(n: int = 14) -> Part:
    return Part(lambda a: {"tr": true_range(a)}, [Trailing({"atr_simple": Frame("mean", "tr", n, n)})])


def directional_moves(axis: Axis) -> dict[str, Column]:
    up = _c("high") - prev("high", axis)
    down = prev("low", axis) - _c("low")
    return {
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "_range": true_range(axis),
    }


def add_adx(df: DataFrame, axis: Axis = BARS, n: int = 14) -> DataFrame:
    """Wilder directional indicators and their smoothed index."""
    a = wilder(n)
    df = windowed(df, lambda d, ax: d.withColumns(directional_moves(ax)), axis, lookback=1)
    df = ewm_mean(df, {"_sp": ("_plus", a, n), "_sm": ("_minus", a, n), "_sr": ("_range", a, n)}, axis)
    df = df.withColumns({"plus_di": 100 * ratio("_sp", "_sr"), "minus_di": 100 * ratio("_sm", "_sr")})
    df = df.withColumn("_dx", 100 * ratio(F.abs(_c("plus_di") - _c("minus_di")), _c("plus_di") + _c("minus_di")))
    df = ewm_mean(df, {"adx": ("_dx", a, n)}, axis)
    return df.drop("_plus", "_minus", "_range", "_sp", "_sm", "_sr", "_dx")


def add_adx_simple(df: DataFrame, axis: Axis, n: int = 14) -> DataFrame:
    """The same index over plain rolling sums and means."""
    df = df.withColumns(directional_moves(axis))
    total = roll_sum("_range", axis, n) + TINY
    df = df.withColumns({
        "plus_di_simple": 100 * roll_sum("_plus", axis, n) / total,
        "minus_di_simple": 100 * roll_sum("_minus", axis, n) / total,
    })
    spread = F.abs(_c("plus_di_simple") - _c("minus_di_simple"))
    df = df.withColumn("_dx", 100 * spread / (_c("plus_di_simple") + _c("minus_di_simple") + TINY))
    return df.withColumn("adx_simple", roll_mean("_dx", axis, n)).drop("_plus", "_minus", "_range", "_dx")


def add_macd(df: DataFrame, axis: Axis = BARS, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm_mean(df, {"_fast": ("close", span(fast), fast), "_slow": ("close", span(slow), slow)}, axis)
    df = df.withColumn("macd", _c("_fast") - _c("_slow"))
    df = ewm_mean(df, {"macd_signal": ("macd", span(signal), signal)}, axis)
    return df.withColumn("macd_hist", _c("macd") - _c("macd_signal")).drop("_fast", "_slow")


def bollinger(source, axis: Axis, n: int = 20, k: float = 2.0, population: bool = False) -> dict[str, Column]:
    mid = roll_mean(source, axis, n)
    sd = roll_std(source, axis, n) * ((n - 1) / n) ** 0.5 if population else roll_std(source, axis, n)
    upper, lower = mid + k * sd, mid - k * sd
    return {
        "bb_mid": mid,
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_bandwidth": ratio(upper - lower, mid),
        "bb_percent_b": ratio(_c(source) - lower, upper - lower),
    }


def add_keltner(df: DataFrame, axis: Axis = BARS, n: int = 20, atr_n: int = 10, k: float = 2.0) -> DataFrame:
    return with_parts(df, axis, keltner_part(n, atr_n, k))


def keltner_part(n: int = 20, atr_n: int = 10, k: float = 2.0) -> Part:
    upper, lower = _c("kc_center") + k * _c("_atr"), _c("kc_center") - k * _c("_atr")
    means = Means({"kc_center": ("close", span(n), n), "_atr": ("_tr", wilder(atr_n), atr_n)})
    return Part(lambda a: {"_tr": true_range(a)}, [means], {"kc_upper": upper, "kc_lower": lower, "kc_width": ratio(upper - lower, "kc_center")})


def donchian(axis: Axis, n: int = 20) -> dict[str, Column]:
    upper, lower = roll_max("high", axis, n), roll_min("low", axis, n)
    mid = (upper + lower) / 2
    return {"donchian_upper": upper, "donchian_lower": lower, "donchian_mid": mid, "donchian_width": ratio(upper - lower, mid)}


def add_chaikin(df: DataFrame, axis: Axis = BARS, n: int = 10, back: int = 10, name: str = "chaikin_vol") -> DataFrame:
    return with_parts(df, axis, chaikin_part(n, back, name))


def chaikin_part(n: int = 10, back: int = 10, name: str = "chaikin_vol") -> Part:
    steps = [Means({"_ehl": ("_hl", span(n), n)}), Trailing({"_ehl_back": Frame("first", "_ehl", back + 1)})]
    return Part(lambda a: {"_hl": _c("high") - _c("low")}, steps, {name: 100 * (ratio("_ehl", "_ehl_back") - 1)})


def add_ulcer(df: DataFrame, axis: Axis, n: int = 14, name: str = "ulcer") -> DataFrame:
    peak = roll_max("close", axis, n)
    df = df.withColumn("_dd2", F.pow(100 * ratio(_c("close") - peak, peak), F.lit(2.0)))
    return df.withColumn(name, F.sqrt(roll_mean("_dd2", axis, n))).drop("_dd2")


def add_bull_bear(df: DataFrame, axis: Axis = BARS, n: int = 13) -> DataFrame:
    return with_parts(df, axis, bull_bear_part(n))


def bull_bear_part(n: int = 13) -> Part:
    bull, bear = _c("high") - _c("_base"), _c("low") - _c("_base")
    return Part(lambda a: {}, [Means({"_base": ("close", span(n), n)})], {"bull_power": bull, "bear_power": bear, "bull_bear_power": bull + bear})


def add_stochastic_rsi(df: DataFrame, axis: Axis = BARS, n: int = 14, look: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    df = add_rsi(df, axis, n, "_rsi")

    def add(x: DataFrame, a: Axis) -> DataFrame:
        low, high = roll_min("_rsi", a, look), roll_max("_rsi", a, look)
        x = x.withColumn("_raw", 100 * ratio(_c("_rsi") - low, high - low))
        x = x.withColumn("stoch_rsi_k", roll_mean("_raw", a, k))
        return x.withColumn("stoch_rsi_d", roll_mean("stoch_rsi_k", a, d))

    return windowed(df, add, axis, lookback=look + k + d).drop("_rsi", "_raw")


# --- volatility estimators -------------------------------------------------------------------

_LN2 = 0.6931471805599453


def close_vol(source, axis: Axis, n: int, per_year: Column | float, least: int | None = None) -> Column:
    """Annualised sample deviation of a return column."""
    return roll_std(source, axis, n, least) * F.sqrt(per_year if isinstance(per_year, Column) else F.lit(float(per_year)))


def _annual(variance: Column, per_year) -> Column:
    return F.sqrt(variance * (per_year if isinstance(per_year, Column) else F.lit(float(per_year))))


def parkinson_term() -> Column:
    return F.pow(safe_log_ratio("high", "low"), F.lit(2.0)) / (4 * _LN2)


def garman_klass_term() -> Column:
    hl, co = safe_log_ratio("high", "low"), safe_log_ratio("close", "open")
    return 0.5 * hl * hl - (2 * _LN2 - 1) * co * co


def rogers_satchell_term() -> Column:
    ho, lo = safe_log_ratio("high", "open"), safe_log_ratio("low", "open")
    hc, lc = safe_log_ratio("high", "close"), safe_log_ratio("low", "close")
    return ho * hc + lo * lc


def range_vol(term: Column, axis: Axis, n: int, per_year, least: int | None = None) -> Column:
    return _annual(roll_mean(term, axis, n, least), per_year)


def yang_zhang_variance(axis: Axis, n: int, rs_term: Column, overnight: str, least: int | None = None) -> Column:
    """Overnight variance + k * open-to-close variance + (1-k) * range term."""
    day = safe_log_ratio("close", "open")
    return yang_zhang_mix(roll_var(overnight, axis, n, least), roll_var(day, axis, n, least), roll_mean(rs_term, axis, n, least), n)


def yang_zhang_mix(overnight: Column, day: Column, ranges: Column, n: int) -> Column:
    k = 0.34 / (1.34 + (n + 1) / max(n - 1, 1))
    return overnight + k * day + (1 - k) * ranges


# --- levels, actions, summaries --------------------------------------------------------------

# fixed values: retracement and extension ratios
RETRACEMENT = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTENSION = (1.272, 1.414, 1.618, 2.0, 2.618, 3.618)


def fibonacci(high: Column, low: Column) -> dict[str, Column]:
    """Two maps, level → price, from a swing high and low."""
    width = high - low
    back = F.map_from_arrays(F.array(*[F.lit(str(r)) for r in RETRACEMENT]), F.array(*[high - r * width for r in RETRACEMENT]))
    on = F.map_from_arrays(F.array(*[F.lit(str(r)) for r in EXTENSION]), F.array(*[high + (r - 1) * width for r in EXTENSION]))
    return {"retracement": back, "extension": on}


def action(value, buy: float, sell: float, reverse: bool = False, compat: bool = False) -> Column:
    """Buy/Sell/Neutral label.

    Plain: at or above ``buy`` buys, at or below ``sell`` sells. Reversed oscillators buy low: at or
    below ``sell`` buys, at or above ``buy`` sells. ``compat=True`` keeps the literal threshold order
    (at or below ``buy`` buys first), which labels mid-range values "Buy".
    """
    v = _c(value)
    if not reverse:
        tests = ((v >= buy, "Buy"), (v <= sell, "Sell"))
    elif compat:
        tests = ((v <= buy, "Buy"), (v >= sell, "Sell"))
    else:
        tests = ((v <= sell, "Buy"), (v >= buy, "Sell"))
    return F.when(v.isNull(), "Neutral").when(tests[0][0], tests[0][1]).when(tests[1][0], tests[1][1]).otherwise("Neutral")


def above(value, level) -> Column:
    return F.when(_c(value) > _c(level), "Buy").otherwise("Sell")


AVERAGES = (10, 20, 30, 50, 100, 200)


def _strength(x, gain: str, loss: str):
    """``strength`` on arrays."""
    return 100 - 100 / (1 + over(x[gain], x[loss]))


def core_inputs(axis: Axis) -> dict[str, Column]:
    """What the summary's steps read: columns of a bar and the one before it."""
    before = prev("close", axis)
    return {
        "_gain": gains("close", axis),
        "_loss": losses("close", axis),
        "_lr": log_return("close", axis),
        "_on": F.when((_c("open") > 0) & (before > 0), F.log(_c("open") / before)),
        "_tp": (_c("high") + _c("low") + _c("close")) / 3,
        "_hl": _c("high") - _c("low"),
        "_mid": (_c("high") + _c("low")) / 2,
        "_bp": _c("close") - F.least("low", before),
        "_tr": F.greatest("high", before) - F.least("low", before),
        "_cv": _c("close") * _c("volume"),
        "_pk": parkinson_term(),
        "_gk": garman_klass_term(),
        "_rs": rogers_satchell_term(),
        "_day": safe_log_ratio("close", "open"),
        **directional_moves(axis),
    }


def core_steps() -> list:
    """The summary's frames and recurrences, in the order in which they read each other."""

    def frame(kind: str, source: str, n: int) -> Frame:
        return Frame(kind, source, n, n)

    w14 = wilder(14)
    return [
        Trailing({
            "_low14": frame("min", "low", 14), "_high14": frame("max", "high", 14), "_low26": frame("min", "low", 26), "_high26": frame("max", "high", 26), "_peak14": frame("max", "close", 14),
            **{f"sma_{n}": frame("mean", "close", n) for n in AVERAGES},
            "_mid5": frame("mean", "_mid", 5), "_mid34": frame("mean", "_mid", 34), "_tp20": frame("mean", "_tp", 20), "_mad20": frame("mean_abs_dev", "_tp", 20),
            **{f"{c}{n}": frame("sum", c, n) for c in ("_bp", "_tr") for n in (7, 14, 28)},
            "_wma4": frame("weighted", "close", 4), "_wma9": frame("weighted", "close", 9), "_back10": Frame("first", "close", 11), "_cv20": frame("sum", "_cv", 20), "_v20": frame("sum", "volume", 20),
            "_lr20": frame("std_samp", "_lr", 20), "_pk20": frame("mean", "_pk", 20), "_gk20": frame("mean", "_gk", 20), "_rs20": frame("mean", "_rs", 20),
            "_on20": frame("var_samp", "_on", 20), "_day20": frame("var_samp", "_day", 20),
        }),
        Made({
            "_k": lambda x: 100 * over(x["close"] - x["_low14"], x["_high14"] - x["_low14"]),
            "_raw_hma": lambda x: 2 * x["_wma4"] - x["_wma9"],
            "_dd2": lambda x: (100 * over(x["close"] - x["_peak14"], x["_peak14"])) ** 2,
        }, ("close", "_low14", "_high14", "_wma4", "_wma9", "_peak14")),
        Trailing({"stoch_k": frame("mean", "_k", 3), "hma_9": frame("weighted", "_raw_hma", 3), "_dd14": frame("mean", "_dd2", 14)}),
        Means({
            **{f"ema_{n}": ("close", span(n), n) for n in AVERAGES},
            "_ag": ("_gain", w14, 14), "_al": ("_loss", w14, 14), "atr_14": ("_range", w14, 14),
            "_sp": ("_plus", w14, 14), "_sm": ("_minus", w14, 14),
            "_e12": ("close", span(12), 12), "_e26": ("close", span(26), 26), "_e13": ("close", span(13), 13),
            "_ehl": ("_hl", span(10), 10),
        }),
        Made({"rsi_14": lambda x: _strength(x, "_ag", "_al"), "_dx": lambda x: 100 * over(abs(x["_sp"] - x["_sm"]), where(abs(x["atr_14"]) > 0, x["_sp"] + x["_sm"]))},
             ("_ag", "_al", "atr_14", "_sp", "_sm")),
        Means({"adx_14": ("_dx", w14, 14)}),
        Trailing({"_rsi_low": frame("min", "rsi_14", 14), "_rsi_high": frame("max", "rsi_14", 14), "_ehl10": Frame("first", "_ehl", 11)}),
        Made({"_raw": lambda x: 100 * over(x["rsi_14"] - x["_rsi_low"], x["_rsi_high"] - x["_rsi_low"])}, ("rsi_14", "_rsi_low", "_rsi_high")),
        Trailing({"stoch_rsi_fast_k": frame("mean", "_raw", 3)}),
    ]


def core_outputs() -> dict[str, Column]:
    ultimate = {n: ratio(f"_bp{n}", f"_tr{n}") for n in (7, 14, 28)}
    return {
        "ultimate_osc_7_14_28": 100 * (4 * ultimate[7] + 2 * ultimate[14] + ultimate[28]) / 7,
        "ulcer_index_14": F.sqrt("_dd14"),
        "cci_20": ratio((_c("high") + _c("low") + _c("close")) / 3 - _c("_tp20"), 0.015 * _c("_mad20")),
        "awesome_oscillator": _c("_mid5") - _c("_mid34"),
        "momentum_10": _c("close") - _c("_back10"),
        "williams_r_14": -100 * ratio(_c("_high14") - _c("close"), _c("_high14") - _c("_low14")),
        "ichimoku_base_26": (_c("_high26") + _c("_low26")) / 2,
        "vwma_20": _c("_cv20") / _c("_v20"),
        "rolling_vol_20": _c("_lr20") * F.sqrt(F.lit(252.0)),
        "parkinson_vol_20": _annual(_c("_pk20"), 252),
        "garman_klass_vol_20": _annual(_c("_gk20"), 252),
        "rogers_satchell_vol_20": _annual(_c("_rs20"), 252),
        "yang_zhang_vol_20": _annual(yang_zhang_mix(_c("_on20"), _c("_day20"), _c("_rs20"), 20), 252),
        "macd_12_26": _c("_e12") - _c("_e26"),
        "bull_bear_power": _c("high") + _c("low") - 2 * _c("_e13"),
        "natr_14": 100 * ratio("atr_14", "close"),
        "chaikin_vol_10_10": 100 * (ratio("_ehl", "_ehl10") - 1),
    }


CORE_COLUMNS = (
    "rsi_14", "stoch_k", "cci_20", "adx_14", "awesome_oscillator", "momentum_10", "macd_12_26", "stoch_rsi_fast_k",
    "williams_r_14", "bull_bear_power", "ultimate_osc_7_14_28",
    *[f"{k}_{n}" for n in AVERAGES for k in ("ema", "sma")],
    "ichimoku_base_26", "vwma_20", "hma_9", "atr_14", "natr_14", "rolling_vol_20", "parkinson_vol_20",
    "garman_klass_vol_20", "rogers_satchell_vol_20", "yang_zhang_vol_20", "chaikin_vol_10_10", "ulcer_index_14",
)


def core_summary(df: DataFrame, axis: Axis = BARS, compat: bool = False) -> DataFrame:
    """35 indicators and 25 action labels per bar: one pass of ordered steps behind one exchange."""
    df = with_parts(df, axis, Part(core_inputs, core_steps(), core_outputs()), keep=[*axis.keys, *axis.order, "high", "low", "close"])
    labels = {
        "action_rsi_14": action("rsi_14", 70, 30, True, compat),
        "action_stoch_k": action("stoch_k", 80, 20, True, compat),
        "action_cci_20": action("cci_20", 100, -100, True, compat),
        "action_adx_14": action("adx_14", 25, 20),
        "action_macd": action("macd_12_26", 0, 0),
        "action_momentum_10": action("momentum_10", 0, 0),
        "action_stoch_rsi_k": action("stoch_rsi_fast_k", 80, 20, True, compat),
        "action_williams_r_14": action("williams_r_14", -20, -80, True, compat),
        "action_bull_bear_power": action("bull_bear_power", 0, 0),
        "action_ultimate_osc": action("ultimate_osc_7_14_28", 70, 30, True, compat),
        **{f"action_{k}_{n}": above("close", f"{k}_{n}") for n in AVERAGES for k in ("ema", "sma")},
        "action_ichimoku_base_26": above("close", "ichimoku_base_26"),
        "action_vwma_20": above("close", "vwma_20"),
        "action_hma_9": above("close", "hma_9"),
    }
    return df.withColumns(labels).select(*axis.keys, *axis.order, "close", *CORE_COLUMNS, *labels)


def default_features(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """The 18-column default feature block: one pass of ordered steps behind one exchange."""

    def inputs(a: Axis) -> dict[str, Column]:
        return {"_gain": gains("close", a), "_loss": losses("close", a), "_ret": pct_change("close", a), "_pk": parkinson_term(), "_gk": garman_klass_term(), **directional_moves(a)}

    w14, atr = wilder(14), "atr_14"
    steps = [
        Trailing({
            **{f"sma_{n}": Frame("mean", "close", n, n) for n in (20, 50, 200)}, "_back": Frame("first", "close", 11), "_sd": Frame("std_samp", "close", 20, 20),
            "_vol": Frame("std_samp", "_ret", 20, 20), "_pk20": Frame("mean", "_pk", 20, 20), "_gk20": Frame("mean", "_gk", 20, 20),
        }),
        Means({
            "ema_20": ("close", span(20), 20), "_ag": ("_gain", w14, 14), "_al": ("_loss", w14, 14),
            atr: ("_range", w14, 14), "_sp": ("_plus", w14, 14), "_sm": ("_minus", w14, 14),
            "_e12": ("close", span(12), 12), "_e26": ("close", span(26), 26),
        }),
        Made({
            "plus_di": lambda x: 100 * x["_sp"] / where(x[atr] > 0, x[atr]), "minus_di": lambda x: 100 * x["_sm"] / where(x[atr] > 0, x[atr]), "macd": lambda x: x["_e12"] - x["_e26"],
        }, (atr, "_sp", "_sm", "_e12", "_e26")),
        Made({"_dx": lambda x: 100 * over(abs(x["plus_di"] - x["minus_di"]), x["plus_di"] + x["minus_di"])}, ("plus_di", "minus_di")),
        Means({"adx_14": ("_dx", w14, 14), "macd_signal": ("macd", span(9), 9)}),
    ]
    mid, sd = _c("sma_20"), _c("_sd")
    upper, lower = mid + 2.0 * sd, mid - 2.0 * sd
    outputs = {
        "rsi_14": strength("_ag", "_al"), "mom_10": _c("close") - _c("_back"), "roc_10": 100 * (_c("close") / F.nullif(_c("_back"), F.lit(0.0)) - 1), "bb_bandwidth": 100 * ratio(upper - lower, mid),
        "vol_20": _c("_vol") * F.sqrt(F.lit(252.0)), "parkinson_vol": _annual(_c("_pk20"), 252), "gk_vol": _annual(_c("_gk20"), 252), "macd_hist": _c("macd") - _c("macd_signal"),
    }
    df = with_parts(df, axis, Part(inputs, steps, outputs), keep=[*axis.keys, *axis.order, "close"])
    return df.select(*axis.keys, *axis.order, *DEFAULT_FEATURES)


DEFAULT_FEATURES = (
    "sma_20", "sma_50", "sma_200", "ema_20", "rsi_14", "atr_14", "adx_14", "plus_di", "minus_di", "macd",
    "macd_signal", "macd_hist", "mom_10", "roc_10", "bb_bandwidth", "vol_20", "parkinson_vol", "gk_vol",
)
