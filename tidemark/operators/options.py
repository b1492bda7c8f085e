"""Option quotes: standardising, pricing, implied volatility, surfaces and features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import ratio, to_double
from tidemark.operators.tables import every, keep_last

# fixed values: coefficients of the rational error-function approximation (Abramowitz and Stegun 7.1.26)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, absolute error below 1.5e-7."""
    z = np.abs(x) / 2.0**0.5
    t = 1 / (1 + ERF_P * z)
    poly = np.zeros_like(z)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1 + np.sign(x) * (1 - poly * np.exp(-z * z)))


def _price(sign, spot, strike, tau, vol, rate: float, dividend: float) -> np.ndarray:
    """Price per quote; ``sign`` is 1 for a call, -1 for a put. NaN on missing or non-positive inputs."""
    with np.errstate(all="ignore"):
        sd = vol * np.sqrt(tau)
        d1 = sign * ((np.log(spot / strike) + (rate - dividend + 0.5 * vol * vol) * tau) / sd)
        s, k = spot * np.exp(-dividend * tau), strike * np.exp(-rate * tau)
        price = sign * (s * _cdf(d1) - k * _cdf(d1 - sign * sd))
    return np.where((spot > 0) & (strike > 0) & (tau > 0) & (vol > 0), price, np.nan)


def _arrays(columns) -> list[np.ndarray]:
    return [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]


def _sign(kind: Column) -> Column:
    return F.when(kind == "call", 1.0).otherwise(-1.0)


def black_scholes(kind: Column, spot: Column, strike: Column, tau: Column, vol: Column, rate: float = 0.0, dividend: float = 0.0) -> Column:
    """European call/put price with a continuous dividend yield; null on non-positive inputs."""

    @F.pandas_udf("double")
    def priced(sign: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_price(*_arrays((sign, s, k, t, v)), rate, dividend))

    return priced(_sign(kind), *[c.cast("double") for c in (spot, strike, tau, vol)])


def _halve(price, quote, rate, dividend, low, high, tol, steps) -> np.ndarray:
    """Interval halving of all quotes at once; those that met their price leave the next steps."""
    lo, hi, found = np.full(len(price), low), np.full(len(price), high), np.full(len(price), np.nan)
    open_ = np.arange(len(price))
    for _ in range(steps):
        if not len(open_):
            break
        mid = 0.5 * (lo[open_] + hi[open_])
        gap = _price(*[q[open_] for q in quote], mid, rate, dividend) - price[open_]
        up = gap > 0
        hi[open_[up]], lo[open_[~up]] = mid[up], mid[~up]
        met = np.abs(gap) < tol
        found[open_[met]] = mid[met]
        open_ = open_[~met]
    return np.where(np.isnan(found), 0.5 * (lo + hi), found)


def implied_vol(price: Column, kind: Column, spot: Column, strike: Column, tau: Column, rate: float = 0.0, dividend: float = 0.0,
                low: float = 1e-4, high: float = 5.0, tol: float = 1e-6, steps: int = 100) -> Column:
    """Volatility that reproduces the price, by interval halving over the quotes of an Arrow batch; null where none does."""

    @F.pandas_udf("double")
    def inverted(price: pd.Series, sign: pd.Series, spot: pd.Series, strike: pd.Series, tau: pd.Series) -> pd.Series:
        p, *quote = _arrays((price, sign, spot, strike, tau))
        sign, s, k, t = quote
        worth = sign * (s * np.exp(-dividend * t) - k * np.exp(-rate * t))
        bound = lambda v: _price(*quote, np.full(len(p), v), rate, dividend)
        inside = (p > 0) & (p + tol >= np.maximum(worth, 0.0)) & (p >= bound(low) - tol) & (p <= bound(high) + tol)
        out = np.full(len(p), np.nan)
        out[inside] = _halve(p[inside], [q[inside] for q in quote], rate, dividend, low, high, tol, steps)
        return pd.Series(out)

    return inverted(price, _sign(kind), *[c.cast("double") for c in (spot, strike, tau)])


def option_kind(c: Column) -> Column:
    first = F.lower(F.substring(F.trim(c), 1, 1))
    return F.when(first == "c", "call").when(first == "p", "put")


def standardise(df: DataFrame) -> DataFrame:
    """Days to expiry, year fraction, moneyness, mid price (quoted, else last), spread share and IV source."""
    have = set(df.columns)
    col = lambda n: to_double(n) if n in have else F.lit(None).cast("double")
    numbers = ("strike", "underlying_price", "bid", "ask", "mid_price", "last_price", "implied_volatility", "volume", "open_interest")
    df = df.withColumns({n: col(n) for n in numbers})
    df = df.withColumns({"option_type": option_kind(F.col("option_type")), "quote_date": F.to_date("quote_date"), "expiration": F.to_date("expiration")})
    quoted = F.when((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")), 0.5 * (F.col("bid") + F.col("ask")))
    mid = F.coalesce("mid_price", quoted)
    dte = F.date_diff("expiration", "quote_date").cast("double")
    return df.withColumns({
        "dte": dte, "tau": dte / 365.25, "moneyness": ratio("strike", "underlying_price"),
        "spread_pct": F.when((mid > 0) & (F.col("ask") >= F.col("bid")), (F.col("ask") - F.col("bid")) / mid),
        "mid_price": F.coalesce(mid, F.col("last_price")),
        "iv_source": F.when(F.col("implied_volatility").isNotNull(), "provided").otherwise("missing"),
    })


def fill_implied_vol(df: DataFrame, rate: float = 0.0, dividend: float = 0.0, low: float = 0.01, high: float = 5.0) -> DataFrame:
    """Invert the mid price where the given volatility is missing or out of range."""
    iv = F.col("implied_volatility")
    needed = (iv.isNull() | (iv < low) | (iv > high)) & (F.col("mid_price") > 0)
    solved = F.when(needed, implied_vol(F.col("mid_price"), F.col("option_type"), F.col("underlying_price"), F.col("strike"), F.col("tau"), rate, dividend))
    df = df.withColumn("_solved", solved)
    return df.withColumns({
        "implied_volatility": F.coalesce("_solved", "implied_volatility"),
        "iv_source": F.when(F.col("_solved").isNotNull(), "model_inverted").otherwise(F.col("iv_source")),
    }).drop("_solved")


def clean(df: DataFrame, seq: Sequence[str], dte: tuple[float, float] = (1, 730), moneyness: tuple[float, float] = (0.5, 1.5), iv: tuple[float, float] = (0.01, 5.0),
          max_spread: float | None = None, min_open_interest: float | None = None, keys: Sequence[str] = ("quote_date", "expiration", "strike", "option_type")) -> DataFrame:
    """Quotes inside the limits, the last one per contract and day (``seq`` orders duplicates)."""
    keep = every(
        F.col("quote_date").isNotNull(), F.col("expiration").isNotNull(), F.col("strike").isNotNull(), F.col("underlying_price").isNotNull(),
        F.col("dte").between(*dte), F.col("moneyness").between(*moneyness), F.col("implied_volatility").between(*iv),
        None if max_spread is None else F.col("spread_pct").isNull() | (F.col("spread_pct") <= max_spread),
        None if not min_open_interest else F.coalesce("open_interest", F.lit(0.0)) >= min_open_interest,
    )
    return keep_last(df.where(keep), keys, seq)


def snapshot(df: DataFrame, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Quotes of the latest date at or before ``target``, else of the first date."""
    before = F.max(F.when(F.col("quote_date") <= F.lit(target).cast("date"), F.col("quote_date"))) if target else F.max("quote_date")
    chosen = df.agg(F.coalesce(before, F.min("quote_date")).alias("_day"))
    out = df.join(F.broadcast(chosen), F.col("quote_date") == F.col("_day")).drop("_day")  # one row: the chosen date
    return out.where(F.col("option_type") == kind) if kind and kind != "both" else out


def surface_grid(df: DataFrame, money_step: float = 0.05, dte_step: float = 15.0, by: Sequence[str] = ()) -> DataFrame:
    """Total variance averaged on a moneyness × days grid; holes take the nearest filled bucket; clipped to the observed range.

    Buckets are aggregated before anything else, so what follows works on the grid and not on quotes.
    """
    by = list(by) or ["_one"]
    if by == ["_one"]:
        df = df.withColumn("_one", F.lit(1))
    iv2 = F.col("implied_volatility") * F.col("implied_volatility") * F.col("tau")
    cells = df.groupBy(*by, F.round(F.col("moneyness") / money_step).cast("int").alias("mi"), F.round(F.col("dte") / dte_step).cast("int").alias("ti")).agg(
        F.avg(iv2).alias("w"), F.min("implied_volatility").alias("lo"), F.max("implied_volatility").alias("hi"))
    g = cells.groupBy(*by).agg(
        F.min("mi").alias("m0"), F.max("mi").alias("m1"), F.greatest(F.min("ti"), F.lit(1)).alias("t0"), F.max("ti").alias("t1"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("mi", "ti", "w")).alias("cells"),
    )
    grid = g.withColumn("mi", F.explode(F.sequence("m0", "m1"))).withColumn("ti", F.explode(F.sequence("t0", "t1")))
    far = lambda c: (c["mi"] - F.col("mi")) * (c["mi"] - F.col("mi")) + (c["ti"] - F.col("ti")) * (c["ti"] - F.col("ti"))
    near = F.array_min(F.transform("cells", lambda c: F.struct(far(c).alias("d"), c["mi"].alias("mi"), c["ti"].alias("ti"), c["w"].alias("w"))))
    grid = grid.withColumn("total_variance", near["w"])
    tau = F.col("ti") * dte_step / 365.25
    iv = F.least(F.greatest(F.sqrt(F.col("total_variance") / tau), F.col("lo")), F.col("hi"))
    return grid.select(*[k for k in by if k != "_one"], (F.col("mi") * money_step).alias("moneyness"), (F.col("ti") * dte_step).alias("dte"), "total_variance", iv.alias("implied_volatility"))


def surface_features(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("expiration", "strike"), iv: str = "implied_volatility") -> DataFrame:
    """ATM level, mean and median, term slope (far − near ATM), skew, ranges, counts."""
    by = list(by)
    gap = F.abs(F.col("moneyness") - 1)
    per = df.groupBy(*by, "expiration").agg(F.percentile("dte", F.lit(0.5)).alias("_d"), F.min_by(iv, F.struct(gap, *order)).alias("_atm"))
    term = per.groupBy(*by).agg(F.min_by("_atm", F.struct("_d", "expiration")).alias("_near"), F.max_by("_atm", F.struct(F.col("_d"), -F.unix_date("expiration"))).alias("_far"), F.count(F.lit(1)).alias("expiration_count"))
    inside = lambda lo, hi: F.when(F.col("moneyness").between(lo, hi), F.col(iv))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("quote_count"), F.percentile("underlying_price", F.lit(0.5)).alias("spot"), F.min_by(iv, F.struct(gap, *order)).alias("atm_iv"),
        F.avg(iv).alias("mean_iv"), F.percentile(iv, F.lit(0.5)).alias("median_iv"), F.stddev_samp(iv).alias("iv_dispersion"),
        (F.avg(inside(0.85, 0.95)) - F.avg(inside(1.05, 1.15))).alias("downside_minus_upside_skew"),
        F.min("dte").alias("min_dte"), F.max("dte").alias("max_dte"), F.min("strike").alias("min_strike"), F.max("strike").alias("max_strike"),
    )
    return g.join(term, by).withColumn("term_slope", F.col("_far") - F.col("_near")).drop("_near", "_far")


def underlying_indicators(chain: DataFrame, latest_vol: DataFrame, key: str = "underlying") -> DataFrame:
    """Surface features per underlying with gamma and vega volume proxies, next to the latest realised volatility."""
    good = chain.where((F.col("iv") > 0) & F.col("dte").isNotNull() & F.col("moneyness").isNotNull())
    f = surface_features(good, [key], ("expiration", "strike", "contract_id"), "iv").withColumnRenamed("quote_count", "contracts")
    traded = F.coalesce("gamma", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))
    side = lambda k, lo, hi: F.avg(F.when((F.col("option_type") == k) & F.col("moneyness").between(lo, hi), F.col("iv")))
    p = good.groupBy(key).agg(
        (F.sum(F.when(F.col("option_type") == "call", traded).otherwise(0.0)) - F.sum(F.when(F.col("option_type") == "put", traded).otherwise(0.0))).alias("net_gamma_volume"),
        F.sum(F.coalesce("vega", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))).alias("vega_volume"),
        (side("put", 0.80, 0.95) - side("call", 1.05, 1.20)).alias("put_call_skew"),
    )
    out = f.join(p, key).join(latest_vol, key, "left")
    return out.withColumns({"iv_minus_rv": F.col("atm_iv") - F.col("rv_close_20"), "iv_minus_yz": F.col("atm_iv") - F.col("rv_yang_zhang_20")})
