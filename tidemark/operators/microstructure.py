"""Trades, order flow, liquidity and structure patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, ratio
from tidemark.operators.crosssection import per_group
from tidemark.operators.series import BARS, Axis, checked, pct_change, prev, roll_max, roll_mean, roll_min, roll_std, running, windowed


def trade_features(trades: DataFrame, width: str = "5 minutes", keys=("symbol",)) -> DataFrame:
    """Count, volume, buy and sell volume and their difference per time bucket, in one aggregation."""
    sell = F.col("is_buyer_maker")
    qty = F.col("quantity")
    return (
        trades.groupBy(*keys, F.window("trade_time", width).alias("_w"))
        .agg(
            F.count("quantity").alias("trade_count"),
            F.sum(qty).alias("total_qty"),
            F.sum(F.when(~sell, qty).otherwise(0.0)).alias("buy_qty"),
            F.sum(F.when(sell, qty).otherwise(0.0)).alias("sell_qty"),
        )
        .select(*keys, F.col("_w.start").alias("ts"), "trade_count", "total_qty", "buy_qty", "sell_qty",
                (F.col("buy_qty") - F.col("sell_qty")).alias("trade_delta"))
    )


def volume_profile(trades: DataFrame, bins: int = 50) -> DataFrame:
    """Volume per equal-width, right-closed price bin (1..bins); empty bins are kept.

    The lowest edge is stretched outwards by 0.1 % of the range so that the minimum is inside bin 1.
    """
    span = trades.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    joined = trades.select("price", "quantity").join(F.broadcast(span))  # one row: the price range
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins)
    # closed form first, then a step to the neighbour where rounding put the price across an edge
    guess = F.least(F.greatest(F.ceil((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(1)), F.lit(bins)).cast("int")
    placed = joined.withColumns({"_g": guess, "_e": edges})
    inside = (
        F.when((F.col("_g") > 1) & (F.col("price") <= F.element_at("_e", F.col("_g"))), F.col("_g") - 1)
        .when((F.col("_g") < bins) & (F.col("price") > F.element_at("_e", F.col("_g") + 1)), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    sums = placed.groupBy(inside.alias("price_bin")).agg(F.sum("quantity").alias("volume"))
    every = trades.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("price_bin"))
    return every.join(sums, "price_bin", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def flow_imbalance(buy, sell) -> Column:
    """(buy - sell) / (buy + sell), 0 without volume."""
    buy, sell = (F.col(c) if isinstance(c, str) else c for c in (buy, sell))
    return F.when(buy + sell > 0, (buy - sell) / (buy + sell)).otherwise(0.0)


def vpin(trades: DataFrame, bucket_size: float, keys=("symbol",), order=("trade_time", "trade_id")) -> DataFrame:
    """Order-flow toxicity per equal-volume bucket; a bucket no trade ends in has value 0."""
    axis = Axis(tuple(keys), tuple(order))
    df = running(trades, {"_cum": ("sum", "quantity")}, axis)
    totals = trades.groupBy(*keys).agg(F.sum("quantity").alias("_total"))
    totals = totals.withColumn("_n", F.when(F.col("_total") > 0, F.floor(F.col("_total") / bucket_size)).otherwise(1).cast("long"))
    df = df.join(totals, list(keys))
    bucket = F.least(F.ceil(F.col("_cum") * F.col("_n") / F.col("_total")), F.col("_n")).cast("long")
    sell = F.col("is_buyer_maker")
    flows = df.where("_cum > 0").groupBy(*keys, bucket.alias("bucket")).agg(
        F.sum(F.when(~sell, F.col("quantity")).otherwise(0.0)).alias("_b"), F.sum(F.when(sell, F.col("quantity")).otherwise(0.0)).alias("_s")
    )
    grid = totals.where("_n >= 1").select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("bucket"))
    value = F.coalesce(F.abs(F.col("_b") - F.col("_s")) / F.nullif(F.col("_b") + F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return grid.join(flows, [*keys, "bucket"], "left").select(*keys, "bucket", value.alias("vpin"))


def micro_features(df: DataFrame, axis: Axis | None = None) -> DataFrame:
    """Funding z-score, open-interest change, imbalance, returns, volatility, momentum: what the columns allow."""
    axis = axis or checked(df)
    have = set(df.columns)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        new: dict[str, Column] = {}
        if "funding_rate" in have:
            new["funding_z"] = (F.col("funding_rate") - roll_mean("funding_rate", a, 50)) / (roll_std("funding_rate", a, 50) + 1e-8)
        if "open_interest" in have:
            new["oi_change"] = F.coalesce(pct_change("open_interest", a), F.lit(0.0))
        if {"buy_qty", "sell_qty", "trade_delta"} <= have:
            new["trade_imbalance"] = F.col("trade_delta") / (F.col("buy_qty") + F.col("sell_qty") + 1e-8)
        if "close" in have:
            d = d.withColumn("returns", pct_change("close", a))
            new["volatility"] = roll_std("returns", a, 20)
            new["momentum"] = F.col("close") / (roll_mean("close", a, 20) + 1e-8)
        return d.withColumns(new)

    return windowed(df, add, axis, lookback=60)


def merge_micro(prices: DataFrame, funding: DataFrame | None, interest: DataFrame | None, flow: DataFrame | None) -> DataFrame:
    """Prices with the last funding rate and open interest known, bucketed trade flow, fills and features."""
    from tidemark.operators.joins import asof_join
    from tidemark.operators.tables import forward_fill

    df = prices
    if funding is not None:
        df = asof_join(df, funding, matched="funding_ts")
    if interest is not None:
        df = asof_join(df, interest, matched="oi_ts")
    if flow is not None:
        df = df.join(flow, ["symbol", "ts"], "left")
    carried = [c for c in ("funding_rate", "open_interest", "buy_qty", "sell_qty", "trade_delta", "trade_count", "total_qty") if c in df.columns]
    axis = checked(prices)
    return micro_features(forward_fill(df, carried, axis), axis)


# --- liquidity and structure -----------------------------------------------------------------


def _beyond(gap: Column, level: Column) -> Column:
    """Gap as a share of its level; beyond a level of 0 it is infinite, as in the limit."""
    far = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    return F.when(level == 0, far).otherwise(gap / level)


def _sweep(a: Axis, side: str, look: int, recover: int, wick: float) -> dict[str, Column]:
    """Columns of one side, given ``_swing`` (rolling extreme) on the frame."""
    long = side == "long"
    extreme = "low" if long else "high"
    level, before = prev("_swing", a), prev("_swing", a, 2)
    here, was = F.col(extreme), prev(extreme, a)
    sign = 1 if long else -1
    broke = (sign * (here - level) < 0) & (sign * (was - before) >= 0)
    depth = sign * (level - here)
    return {"_broke": broke & (depth > level * wick), "_level": level, "_quality": clip(_beyond(depth, level) * 100, 0.0, 1.0)}


def liquidity_capture(df: DataFrame, axis: Axis, look: int = 20, recover: int = 5, wick: float = 0.0008) -> DataFrame:
    """Sweep of a swing extreme followed by a close back inside within ``recover`` bars.

    ``lookahead`` is part of the definition: the flag of a bar uses the next ``recover - 1`` closes, each
    against the swing level of its own bar.
    """
    for side, roll, extreme in (("long", roll_min, "low"), ("short", roll_max, "high")):
        df = df.withColumn("_swing", roll(extreme, axis, look))
        parts = _sweep(axis, side, look, recover, wick)
        df = df.withColumns(parts)
        inside = F.col("close") > F.col("_level") if side == "long" else F.col("close") < F.col("_level")
        df = df.withColumn("_inside", F.coalesce(inside, F.lit(False)).cast("int"))
        w = axis.rows(0, recover - 1)
        back = (F.max("_inside").over(w) > 0) & (F.count(F.lit(1)).over(w) >= recover)
        hit = F.coalesce(F.col("_broke") & back, F.lit(False))
        df = df.withColumn(f"liq_capture_{side}", hit)
        df = df.withColumn(f"liq_quality_{side}", F.when(F.col(f"liq_capture_{side}"), F.col("_quality")).otherwise(0.0))
    return df.drop("_swing", "_broke", "_level", "_quality", "_inside")


def structure_break(df: DataFrame, axis: Axis, look: int = 20, least: float = 0.0005) -> DataFrame:
    """Close beyond the prior extreme after a liquidity capture on the same side, with its strength."""
    for name, capture, roll, extreme, sign in (
        ("bullish", "liq_capture_long", roll_max, "high", 1), ("bearish", "liq_capture_short", roll_min, "low", -1)
    ):
        df = df.withColumn("_edge", roll(extreme, axis, look, 1))
        edge = prev("_edge", axis)
        push = _beyond(sign * (F.col("close") - edge), edge)
        df = df.withColumns({"_push": push, "_had": F.max(F.col(capture).cast("int")).over(axis.trailing(2 * look)) > 0})
        broke = F.coalesce((F.col("_push") > 0) & (F.col("_push") > least), F.lit(False))
        df = df.withColumn(f"msb_{name}", broke).withColumn(f"msb_{name}_valid", F.col(f"msb_{name}") & F.col("_had"))
        strength = clip(F.col("_push") * 100 / 0.1, 0.0, 1.0)
        df = df.withColumn(f"msb_quality_{name}", F.when(F.col(f"msb_{name}_valid"), strength).otherwise(0.0))
    return df.drop("_edge", "_push", "_had")


def confluence(df: DataFrame, trend: DataFrame, room: DataFrame, ts: str = "ts") -> DataFrame:
    """Filters from two benchmark series, each carried forward to the rows of ``df``.

    ``trend`` gives delta_norm, close and vwap; ``room`` gives gamma_magnitude, close and the second
    vwap bands. Both have one series, so the as-of join runs on time alone, one benchmark per date.
    """
    from tidemark.operators.joins import asof_join

    one = F.lit(1)
    t = trend.select(one.alias("_k"), ts, F.col("delta_norm").alias("spy_trend"), (100 * ratio(F.col("close") - F.col("vwap"), "vwap")).alias("spy_vwap_dist"))
    r = room.select(one.alias("_k"), ts, F.col("gamma_magnitude").alias("qqq_gamma"), (F.col("close") < F.col("vwap_upper_2")).alias("_under"), (F.col("close") > F.col("vwap_lower_2")).alias("_over"))
    # benchmark values are looked up per distinct time first, then joined to the rows
    times = df.select(ts).distinct().withColumn("_k", one)
    side = asof_join(asof_join(times, t, ("_k",), ts, matched="_m1"), r, ("_k",), ts, matched="_m2").drop("_k", "_m1", "_m2")
    j = df.join(side, ts, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({
        "spy_long_ok": flag((F.col("spy_trend") > 0.05) & (F.col("spy_vwap_dist") > -1.5)),
        "spy_short_ok": flag((F.col("spy_trend") < -0.05) & (F.col("spy_vwap_dist") < 1.5)),
        "qqq_long_ok": flag(F.col("_under") & (F.col("qqq_gamma") > 0.3)),
        "qqq_short_ok": flag(F.col("_over") & (F.col("qqq_gamma") > 0.3)),
    }).drop("_under", "_over")


# fixed values: points per component and rating thresholds
POINTS = {"liquidity": 30, "structure": 30, "vwap": 20, "trend": 10, "room": 5, "momentum": 5}
RATINGS = ((95, "A+"), (85, "A"), (80, "B"))


def quality_score(axis: Axis, side: str, look: int = 20) -> Column:
    """0–100 points of one direction, each component weighted by its quality."""
    long = side == "long"
    sign = 1 if long else -1
    w = axis.trailing(2 * look)
    had = F.max(F.col(f"liq_capture_{side}").cast("int")).over(w) > 0
    quality = F.coalesce(F.max(f"liq_quality_{side}").over(w), F.lit(0.0))
    name = "bullish" if long else "bearish"
    d = F.abs("vwap_distance_pct")
    near = F.when(d < 0.5, 1.0).when(d < 1.0, 0.8).when(d < 2.0, 0.5).when(d < 3.0, 0.2).otherwise(0.0)
    right = F.when(sign * F.col("vwap_distance_pct") > 0, 1.0).otherwise(0.7)
    # a component without its benchmark counts nothing
    strength = F.coalesce(clip(sign * F.col("spy_trend"), 0.0, 0.3) / 0.3, F.lit(0.0))
    on = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    total = (
        on(had) * POINTS["liquidity"] * (0.5 + 0.5 * quality)
        + on(F.col(f"msb_{name}_valid")) * POINTS["structure"] * (0.5 + 0.5 * F.col(f"msb_quality_{name}"))
        + near * right * POINTS["vwap"]
        + on(F.col(f"spy_{side}_ok")) * POINTS["trend"] * (0.5 + 0.5 * strength)
        + on(F.col(f"qqq_{side}_ok")) * POINTS["room"]
        + on(sign * F.col("delta_norm") > 0.1) * POINTS["momentum"] * F.coalesce(clip(sign * F.col("delta_norm"), 0.0, 1.0), F.lit(0.0))
    )
    return F.round(total, 1)


def rating(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    out = F.when(score >= RATINGS[0][0], RATINGS[0][1])
    for least, name in RATINGS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("-")


def opening_range(df: DataFrame, axis: Axis = BARS, session: str = "day", bars: int = 6) -> DataFrame:
    """High, low and width of the first bars of each session."""
    within = axis.within(session)
    k = F.row_number().over(within.spec())  # a session holds a bounded number of bars
    df = df.withColumn("session_bar", k)
    early = F.col("session_bar") <= bars
    df = per_group(df, within.keys, {"orb_high": F.max(F.when(early, F.col("high"))), "orb_low": F.min(F.when(early, F.col("low")))})
    return df.withColumn("orb_width", F.col("orb_high") - F.col("orb_low"))


def gap_flags(df: DataFrame, axis: Axis, session: str = "day", least: float = 0.003, hold: int = 40) -> DataFrame:
    """Overnight gap against the previous bar's close, held for ``hold`` bars after the session's first bar."""
    before, other = prev("close", axis), prev(session, axis)
    first = F.col(session) != other
    df = df.withColumn("_gap", F.when(first, F.col("open") / before - 1))
    w = axis.trailing(hold + 1)
    return df.withColumns({
        "gap_up": F.coalesce(F.max((F.col("_gap") > least).cast("int")).over(w) > 0, F.lit(False)),
        "gap_down": F.coalesce(F.max((F.col("_gap") < -least).cast("int")).over(w) > 0, F.lit(False)),
    }).drop("_gap")


def delta_divergence(df: DataFrame, axis: Axis, look: int = 20, back: int = 5) -> DataFrame:
    """New price extreme that the cumulative delta does not confirm."""
    df = df.withColumns({
        "_ph": roll_max("high", axis, look), "_pl": roll_min("low", axis, look),
        "_ch": roll_max("cumulative_delta", axis, look), "_cl": roll_min("cumulative_delta", axis, look),
    })
    no = F.lit(False)
    bear = (F.col("high") >= prev("_ph", axis)) & (F.col("cumulative_delta") < prev("_ch", axis, back))
    bull = (F.col("low") <= prev("_pl", axis)) & (F.col("cumulative_delta") > prev("_cl", axis, back))
    return df.withColumns({"bear_div": F.coalesce(bear, no), "bull_div": F.coalesce(bull, no)}).drop("_ph", "_pl", "_ch", "_cl")
