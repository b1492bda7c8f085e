"""Signals, weights, back-tests, metrics and the flagship comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import crosssection as xs
from tidemark.operators import indicators as ind
from tidemark.operators import metrics as mx
from tidemark.operators import microstructure as ms
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sg
from tidemark.operators import tables as tb
from tidemark.operators.frames import Frame, Frames, with_frames
from tidemark.operators.series import BARS, Axis, checked, log_return, pct_change, positions, prev, roll_mean, roll_std, running, spread, windowed
from tidemark.plans.catalog.windows import P, SEL, frame, roll
from tidemark.plans.registry import ewm_sql, num, nums, qnum, qnums, query, text, with_ctes
from tidemark.plans.regime_comparison import compare
from tidemark.operators.recurrences import span, wilder
from tidemark.sources import bindings as b

OPEN_GROUP = ("asia",)


def returns(spark, d):
    return windowed(b.bars(spark, d), lambda x, a: x.withColumn("ret", pct_change("close", a)), lookback=1)


def market(df):
    """Add the cross-section mean return of the date."""
    return xs.per_group(df, ["ts"], {"mkt": F.avg("ret")})


# --- signals ---------------------------------------------------------------------------------


@query("signal_sma_cross", "G1 G15 F1 F7", with_ctes("bars", f"""s AS (SELECT *, CASE WHEN coalesce(({roll("avg", "close", 20)}) > ({roll("avg", "close", 100)}), false) THEN 1.0::DOUBLE ELSE 0 END AS signal FROM bars)
 {SEL}, {qnum("signal", "signal")}, {qnum(f"coalesce(lag(signal, 3) OVER ({P}), 0)", "delayed")} FROM s"""))
def signal_sma_cross(spark, d):
    df = b.bars(spark, d).transform(sg.strategy("sma_cross", fast=20, slow=100))
    df = windowed(df, lambda x, a: x.withColumn("delayed", sg.delayed("signal", a, 3)), lookback=3)
    return df.select("symbol", text("ts"), *nums("signal", "delayed"))


@query("signal_mean_reversion", "G2 scan", with_ctes("bars", f"""z AS (SELECT *, row_number() OVER ({P}) AS rn, coalesce((close - ({roll("avg", "close", 50)})) / nullif(({roll("stddev_samp", "close", 50)}), 0), 0) AS z FROM bars),
 r AS (SELECT symbol, rn, ts, CASE WHEN z <= -1.5 THEN 1.0::DOUBLE WHEN z >= 1.5 THEN -1.0 ELSE 0.0 END AS s FROM z WHERE rn = 1
  UNION ALL SELECT z.symbol, z.rn, z.ts, CASE WHEN r.s = 0 THEN CASE WHEN z.z <= -1.5 THEN 1.0::DOUBLE WHEN z.z >= 1.5 THEN -1.0 ELSE 0.0 END
   WHEN r.s > 0 THEN CASE WHEN z.z >= -0.3 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN z.z <= 0.3 THEN 0.0 ELSE -1.0 END END
   FROM r JOIN z ON z.symbol = r.symbol AND z.rn = r.rn + 1) {SEL}, {qnum("s", "signal")} FROM r"""))
def signal_mean_reversion(spark, d):
    return sg.mean_reversion(b.bars(spark, d)).select("symbol", text("ts"), num("signal").alias("signal"))


IBANDS = f"""v AS (SELECT *, row_number() OVER ({P}) AS rn, sum(close * volume) OVER s / sum(volume) OVER s AS vwap FROM intraday WINDOW s AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 w AS (SELECT *, coalesce(stddev_samp(close - vwap) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS sd FROM v)"""


@query("signal_vwap_reversion", "G3 G8", with_ctes("intraday", IBANDS + """,
 c AS (SELECT symbol, rn, ts, CASE WHEN close < vwap - 2 * sd THEN 1 WHEN close > vwap + 2 * sd THEN -1 ELSE 0 END AS raw FROM w),
 r AS (SELECT symbol, rn, ts, raw AS s, CASE WHEN raw <> 0 THEN rn ELSE -1000 END AS last FROM c WHERE rn = 1
  UNION ALL SELECT c.symbol, c.rn, c.ts, CASE WHEN c.rn - r.last >= 10 THEN c.raw ELSE 0 END, CASE WHEN c.rn - r.last >= 10 AND c.raw <> 0 THEN c.rn ELSE r.last END
   FROM r JOIN c ON c.symbol = r.symbol AND c.rn = r.rn + 1)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, """ + qnum("s", "signal") + " FROM r"))
def signal_vwap_reversion(spark, d):
    from tidemark.operators.sessions import anchored_vwap

    return sg.vwap_reversion(anchored_vwap(b.intraday(spark, d))).select("symbol", text("ts"), num("signal").alias("signal"))


@query("signal_institutional", "G4 G8", with_ctes("intraday", IBANDS + f""",
 e AS (SELECT *, 100 * (close - vwap) / vwap AS vd, {roll("min", "low", 20)} AS sl, {roll("max", "high", 20)} AS sh, max(high) OVER {frame(20)} AS ph, min(low) OVER {frame(20)} AS pl,
   CASE WHEN count(*) OVER nx >= 5 THEN max(close) OVER nx END AS nmax, CASE WHEN count(*) OVER nx >= 5 THEN min(close) OVER nx END AS nmin FROM w WINDOW nx AS ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
 f AS (SELECT *, lag(sl) OVER o AS l1, lag(sl, 2) OVER o AS l2, lag(sh) OVER o AS h1, lag(sh, 2) OVER o AS h2, lag(low) OVER o AS low1, lag(high) OVER o AS high1,
   lag(ph) OVER o AS ph1, lag(pl) OVER o AS pl1, lag(close) OVER o AS c1 FROM e WINDOW o AS ({P})),
 g AS (SELECT *, coalesce(low < l1 AND low1 >= l2 AND l1 - low > l1 * 0.0008 AND nmax > l1, false) AS ll, coalesce(high > h1 AND high1 <= h2 AND high - h1 > h1 * 0.0008 AND nmin < h1, false) AS ss,
   coalesce(close > ph1 AND (close - ph1) / ph1 > 0.0005, false) AS mb, coalesce(close < pl1 AND (pl1 - close) / pl1 > 0.0005, false) AS mb2 FROM f),
 h AS (SELECT *, max(CASE WHEN ll THEN 1 ELSE 0 END) OVER {frame(40)} > 0 AS hl, max(CASE WHEN ss THEN 1 ELSE 0 END) OVER {frame(40)} > 0 AS hs FROM g),
 c AS (SELECT symbol, rn, ts, coalesce(rn > 40 AND (CASE WHEN hl THEN 30 ELSE 0 END + CASE WHEN mb AND hl THEN 30 ELSE 0 END + CASE WHEN abs(vd) < 60 THEN 20 ELSE 0 END) >= 70 AND close > c1, false) AS lo,
   coalesce(rn > 40 AND (CASE WHEN hs THEN 30 ELSE 0 END + CASE WHEN mb2 AND hs THEN 30 ELSE 0 END + CASE WHEN abs(vd) < 60 THEN 20 ELSE 0 END) >= 70 AND close < c1, false) AS sh FROM h),
 r AS (SELECT symbol, rn, ts, 0 AS s, -1000 AS last FROM c WHERE rn = 1
  UNION ALL SELECT c.symbol, c.rn, c.ts, CASE WHEN c.rn - r.last >= 20 THEN CASE WHEN lo THEN 1 WHEN sh THEN -1 ELSE 0 END ELSE 0 END,
   CASE WHEN c.rn - r.last >= 20 AND (lo OR sh) THEN c.rn ELSE r.last END FROM r JOIN c ON c.symbol = r.symbol AND c.rn = r.rn + 1)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, """ + qnum("s", "signal") + " FROM r"))
def signal_institutional(spark, d):
    from tidemark.operators.sessions import anchored_vwap

    df = sg.institutional(anchored_vwap(b.intraday(spark, d)), tolerance=60.0)
    return df.select("symbol", text("ts"), num("signal").alias("signal"))


ROUTER = f"""q AS (SELECT *, coalesce(ret, 0) AS r0, row_number() OVER ({P}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM nb),
 q2 AS (SELECT *, {roll("stddev_samp", "r0", 20)} AS vol, -sign(r0) AS rev, sign({roll("avg", "r0", 5)}) AS mom, sign({roll("avg", "r0", 3)}) AS mom3 FROM q),
 th AS (SELECT symbol, quantile_cont(CASE WHEN p < floor(n * 0.7::DOUBLE) THEN vol END, 0.5) AS lvl FROM q2 GROUP BY symbol),
 q3 AS (SELECT q2.*, CASE WHEN coalesce(vol >= lvl, false) THEN rev ELSE mom END AS dir, CASE WHEN coalesce(vol >= lvl, false) THEN rev ELSE mom3 END AS dir3 FROM q2 JOIN th USING (symbol))"""


@query("signal_routers", "G5 G6 G7 W8 W13", with_ctes("bars nb", ROUTER + f""",
 i AS (SELECT *, {roll("avg", "vol", 20)} AS inten FROM q3),
 k AS (SELECT *, CASE WHEN inten IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY inten NULLS LAST) + (count(*) OVER (PARTITION BY symbol, inten) - 1) / 2) / count(inten) OVER (PARTITION BY symbol) END AS rk FROM i),
 v0 AS (SELECT symbol, rn, vol FROM q3), """ + ewm_sql("v0", {"ie": ("vol", span(20))}) + f""",
 j AS (SELECT k.*, ie FROM k JOIN ew USING (symbol, rn)),
 rl AS (SELECT a.symbol, a.rn, count(x.ie) AS obs, count(*) FILTER (x.ie < a.ie) / count(*) AS rk2 FROM j a JOIN j x ON x.symbol = a.symbol AND x.rn BETWEEN a.rn - 251 AND a.rn GROUP BY a.symbol, a.rn)
 {SEL}, {qnum("coalesce(dir, 0)", "router")}, {qnum("coalesce(CASE WHEN rk >= 0.7 THEN dir ELSE 0 END, 0)", "hard")},
 {qnum("coalesce(CASE WHEN rk IS NULL THEN NULL ELSE least(greatest(rk - 0.5, 0) * 2, 1) END * dir, 0)", "soft")},
 {qnum("coalesce(CASE WHEN obs >= 20 AND ie IS NOT NULL AND rk2 >= 0.7 THEN dir3 ELSE 0 END, 0)", "hard_ewm")} FROM j LEFT JOIN rl USING (symbol, rn)"""))
def signal_routers(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    ax = checked(bars)
    bars = spread(bars, ax, 16)  # one task sorts its rows some sixteen times
    keep = lambda df, n: df.select("symbol", "ts", "close", *[c for c in df.columns if c in ("router", "hard", "soft")], F.col("signal").alias(n))
    df = keep(sg.regime_router(bars, axis=ax), "router")
    df = keep(sg.intensity_gated(df, "hard", axis=ax), "hard")
    df = keep(sg.intensity_gated(df, "soft", axis=ax), "soft")
    df = keep(sg.hard_gate_ewm(df, axis=ax), "hard_ewm")
    return df.select("symbol", text("ts"), *nums("router", "hard", "soft", "hard_ewm"))


FAMILY = f"""i AS (SELECT *, {roll("avg", "volume", 10, 3)} AS inten, coalesce(lag(ret) OVER ({P}), 0) AS kn FROM nb),
 i2 AS (SELECT *, coalesce(inten - lag(inten) OVER ({P}), 0) AS di, avg(kn) OVER (PARTITION BY ts) AS mk,
   CASE WHEN inten IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY inten NULLS LAST) + (count(*) OVER (PARTITION BY ts, inten) - 1) / 2) / count(inten) OVER (PARTITION BY ts) END AS rk FROM i),
 i3 AS (SELECT *, greatest(coalesce((di - avg(di) OVER (PARTITION BY ts)) / nullif(stddev_samp(di) OVER (PARTITION BY ts), 0), 0), 0) AS accel,
   coalesce(-sign(kn), 0) AS rev1, coalesce(sign({roll("avg", "kn", 3, 2)}), 0) AS mom3, coalesce(sign({roll("avg", "kn", 5, 3)}), 0) AS mom5, coalesce(sign({roll("avg", "kn", 10, 5)}), 0) AS mom10, coalesce(sign({roll("avg", "kn", 20, 10)}), 0) AS mom20,
   coalesce(-sign(kn - mk), 0) AS resid_rev, coalesce(sign(0.6::DOUBLE * ({roll("avg", "kn", 5, 3)}) + 0.4::DOUBLE * ({roll("avg", "kn", 10, 5)})), 0) AS mom_mix, CASE WHEN volume > 25 THEN 1 ELSE 0 END AS reg FROM i2)"""


@query("cross_section_signals", "G10 G11 G12 W12", with_ctes("bars nb", FAMILY + f""" {SEL}, {qnums("accel", "rev1", "mom3", "mom5", "mom10", "mom20", "resid_rev", "mom_mix")},
 {qnum("CASE WHEN coalesce(rk >= 0.70, false) THEN CASE WHEN reg = 1 THEN rev1 ELSE mom3 END ELSE 0 END", "s1_hard70_mom3_rev")},
 {qnum("coalesce(CASE WHEN rk IS NOT NULL THEN least(2 * greatest(rk - 0.5, 0), 1) END, 0) * CASE WHEN reg = 1 THEN rev1 ELSE mom5 END", "s2_soft_mom5_rev")},
 {qnum("accel * CASE WHEN reg = 1 THEN rev1 ELSE mom10 END", "s3_accel_mom10_rev")},
 {qnum("CASE WHEN coalesce(rk >= 0.65, false) THEN CASE WHEN reg = 1 THEN 0 ELSE mom5 END ELSE 0 END", "s4_hard65_mom5_flat")} FROM i3"""))
def cross_section_signals(spark, d):
    df = returns(spark, d)
    ax = checked(df)
    df = windowed(df, lambda x, a: x.withColumns({"inten": roll_mean("volume", a, 10, 3), "kn": F.coalesce(prev("ret", a), F.lit(0.0))}), ax, lookback=10)
    df = xs.pct_rank(df, "inten", ["ts"], "rk")
    df = sg.acceleration(df, "inten", ax)
    df = sg.directions(df, "kn", ax)
    df = df.withColumns(sg.signal_family(F.col("rk"), (F.col("volume") > 25).cast("double"), F.col("accel")))
    return df.select("symbol", text("ts"), *nums("accel", "rev1", "mom3", "mom5", "mom10", "mom20", "resid_rev", "mom_mix",
                     "s1_hard70_mom3_rev", "s2_soft_mom5_rev", "s3_accel_mom10_rev", "s4_hard65_mom5_flat"))


@query("sleeve_filters", "G13 B6 W4", with_ctes("bars nb", f"""m AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS mk FROM nb),
 x AS (SELECT *, coalesce({roll("stddev_samp", "ret", 20, 10)}, 0) AS vol, coalesce(CASE WHEN count(ret + mk) OVER {frame(60)} >= 20 THEN covar_samp(ret, mk) OVER {frame(60)} END / nullif(CASE WHEN count(mk) OVER {frame(60)} >= 20 THEN var_samp(mk) OVER {frame(60)} END, 0), 0) AS beta,
   coalesce({roll("avg", "ret", 20, 10)}, 0) AS tr FROM m),
 y AS (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY vol) + (count(*) OVER (PARTITION BY ts, vol) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS vr,
   (rank() OVER (PARTITION BY ts ORDER BY beta) + (count(*) OVER (PARTITION BY ts, beta) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS br,
   (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS ir FROM x)
 {SEL}, {qnum("round(beta, 5)", "beta", 5)}, {", ".join(qnum(f"CASE WHEN {c} THEN 1 ELSE 0 END", n) for n, c in (("high_intensity", "ir >= 0.5"), ("low_intensity", "ir < 0.5"), ("positive_trend", "tr > 0"), ("top_conviction_30", "ir >= 0.7")))} FROM y"""))
def sleeve_filters(spark, d):
    df = market(returns(spark, d))
    ax = checked(df)
    own = Frames({"_vol": Frame("std_samp", "ret", 20, 10), "_tr": Frame("mean", "ret", 20, 10)}, {"vol": F.coalesce("_vol", F.lit(0.0)), "tr": F.coalesce("_tr", F.lit(0.0))})
    df = windowed(df.select("symbol", "ts", "volume", "ret", "mkt"), lambda x, a: with_frames(x, a, own, pf.rolling_beta("ret", "mkt", 60, 20)), ax, lookback=60)
    for c, o in (("vol", "vr"), ("beta", "br"), ("volume", "ir")):
        df = xs.pct_rank(df, c, ["ts"], o)
    df = df.withColumns(sg.sleeves(F.col("ir"), F.col("vr"), F.col("br"), F.col("tr"), F.col("ir")))
    return df.select("symbol", text("ts"), num(F.round("beta", 5), 5).alias("beta"), *nums("high_intensity", "low_intensity", "positive_trend", "top_conviction_30"))


@query("investor_profiles", "G14", with_ctes("bars nb", f"""s AS (SELECT *, rn - 1 AS p, (close - 105) / 5 AS sig FROM nb),
 v AS (SELECT *, count(*) OVER k AS c20, stddev_samp(ret) OVER k AS sd FROM s WINDOW k AS ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 {SEL}, {qnum("0.8::DOUBLE * greatest(-0.5, least(0.5, sig))", "conservative")}, {qnum("greatest(-0.75, least(0.75, sig))", "moderate")},
 {qnum("greatest(-1.5, least(1.5, 1.5::DOUBLE * greatest(-1, least(1, sig))))", "aggressive")},
 {qnum("CASE WHEN p >= 20 AND c20 >= 5 AND sd >= 1e-8 THEN greatest(0.1, least(3, 0.15::DOUBLE / sd)) ELSE 1 END", "scale_moderate")} FROM v"""))
def investor_profiles(spark, d):
    df = positions(returns(spark, d)).withColumn("sig", (F.col("close") - 105) / 5)
    df = windowed(df, lambda x, a: x.withColumns({**{n: p.shape("sig") for n, p in sg.PROFILES.items()},
                  "scale_moderate": sg.PROFILES["moderate"].vol_scale("ret", a, F.col("rn"))}), lookback=21)
    return df.select("symbol", text("ts"), *nums("conservative", "moderate", "aggressive", "scale_moderate"))


@query("cooldown_dedup", "G8", with_ctes("bars", f"""c AS (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS rn, close > 108 AS hi, close < 102 AS lo FROM bars),
 r AS (SELECT symbol, ts, rn, hi AS kh, CASE WHEN hi THEN 0 ELSE -100 END AS lh, lo AS kl, CASE WHEN lo THEN 0 ELSE -100 END AS ll FROM c WHERE rn = 0
  UNION ALL SELECT c.symbol, c.ts, c.rn, c.hi AND c.rn - lh >= 10, CASE WHEN c.hi AND c.rn - lh >= 10 THEN c.rn ELSE lh END, c.lo AND c.rn - ll >= 10, CASE WHEN c.lo AND c.rn - ll >= 10 THEN c.rn ELSE ll END
   FROM r JOIN c ON c.symbol = r.symbol AND c.rn = r.rn + 1)
 {SEL}, kh AS kept_high, kl AS kept_low FROM r"""))
def cooldown_dedup(spark, d):
    df = positions(b.bars(spark, d)).withColumns({"hi": F.col("close") > 108, "lo": F.col("close") < 102})
    return sg.cooldown(df, {"kept_high": "hi", "kept_low": "lo"}, 10).select("symbol", text("ts"), "kept_high", "kept_low")


# --- weights ---------------------------------------------------------------------------------


@query("weights_basic", "B1 B2 B3 F2", with_ctes("bars nb", f"""v AS (SELECT *, {roll("stddev_samp", "ret", 20, 10)} * sqrt(252) AS vol FROM nb),
 md AS (SELECT symbol, quantile_cont(vol, 0.5) AS md FROM v GROUP BY symbol),
 x AS (SELECT v.*, md, CASE WHEN volume > 10 THEN 1.0::DOUBLE ELSE 0 END AS el FROM v JOIN md USING (symbol)),
 w AS (SELECT *, coalesce(el / nullif(sum(el) OVER d, 0), 0) AS ew, coalesce(coalesce(el / nullif(vol, 0), 0) / nullif(sum(coalesce(el / nullif(vol, 0), 0)) OVER d, 0), 0) AS iv FROM x WINDOW d AS (PARTITION BY ts)),
 t AS (SELECT *, sum(iv * coalesce(vol, md)) OVER (PARTITION BY ts) AS wv FROM w)
 {SEL}, {qnum("ew", "equal_weight")}, {qnum("iv", "inverse_vol")}, {qnum("CASE WHEN wv > 0 THEN iv * least(0.15::DOUBLE / wv, 1.5) ELSE 0 END", "vol_target")} FROM t"""))
def weights_basic(spark, d):
    df = returns(spark, d)
    df = windowed(df, lambda x, a: x.withColumn("vol", roll_std("ret", a, 20, 10) * F.sqrt(F.lit(252.0))), lookback=20)
    ok = F.col("volume") > 10
    df = pf.equal_weight(df, ["ts"], ok, "equal_weight")
    df = pf.inverse_vol(df, ["ts"], "vol", ok, "inverse_vol").withColumn("vol_target", F.col("inverse_vol"))
    df = pf.vol_target(df, ["ts"], "vol_target", "vol", 0.15, 1.5)
    return df.select("symbol", text("ts"), *nums("equal_weight", "inverse_vol", "vol_target"))


@query("weights_tilted", "B4 B5 B13", with_ctes("bars nb", f"""a AS (SELECT *, close - 105 AS al, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS base FROM bars),
 t AS (SELECT *, al - avg(al) OVER (PARTITION BY ts) AS x FROM a), t2 AS (SELECT *, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY ts), 0), 0) AS tl FROM t),
 t3 AS (SELECT *, greatest(base + 0.2::DOUBLE * tl, 0) AS y, greatest(-0.08, least(0.08, tl)) AS c, greatest(al, 0) AS lp FROM t2),
 t4 AS (SELECT *, y / sum(y) OVER d AS tilted, coalesce(c / nullif(sum(abs(c)) OVER d, 0), 0) AS ls, coalesce(lp / nullif(sum(lp) OVER d, 0), 0) AS l0 FROM t3 WINDOW d AS (PARTITION BY ts)),
 t5 AS (SELECT *, coalesce(least(l0, 0.15) / nullif(sum(least(l0, 0.15)) OVER (PARTITION BY ts), 0), 0) AS l1 FROM t4),
 t6 AS (SELECT *, 0.75::DOUBLE * l1 + 0.25::DOUBLE * base AS m FROM t5), t7 AS (SELECT *, sum(abs(al / 20)) OVER (PARTITION BY ts) AS g FROM t6)
 {SEL}, {qnums("tilted")}, {qnum("ls", "long_short")}, {qnum("m / sum(m) OVER (PARTITION BY ts)", "long_mixed")}, {qnum("al / 20 * CASE WHEN g > 1 THEN 1 / g ELSE 1 END", "limited")} FROM t7"""))
def weights_tilted(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", (F.col("close") - 105).alias("al"))
    df = pf.equal_weight(df, ["ts"], F.lit(True), "base")
    df = pf.tilt(df, ["ts"], "al", "tilted", "base", 0.2)
    df = pf.capped(df, ["ts"], "al", "long_short", "ls", 0.08)
    df = pf.capped(df, ["ts"], "al", "long_mixed", "long", 0.15, "base", 0.25)
    df = pf.limit_gross(df.withColumn("w20", F.col("al") / 20), ["ts"], "w20", "limited", 1.0)
    return df.select("symbol", text("ts"), *nums("tilted", "long_short", "long_mixed", "limited"))


@query("weights_beta_neutral", "B6", with_ctes("bars", f"""a AS (SELECT symbol, ts, close - 105 AS al, volume / 25 AS be FROM bars),
 x AS (SELECT *, al - avg(al) OVER (PARTITION BY ts) AS x FROM a), y AS (SELECT *, x - be * coalesce(sum(x * be) OVER d / nullif(sum(be * be) OVER d, 0), 0) AS y FROM x WINDOW d AS (PARTITION BY ts)),
 z AS (SELECT *, y - avg(y) OVER (PARTITION BY ts) AS z FROM y), w AS (SELECT *, coalesce(z / nullif(sum(abs(z)) OVER (PARTITION BY ts), 0), 0) AS w, count(*) OVER (PARTITION BY ts) AS n FROM z),
 c AS (SELECT *, greatest(-0.08, least(0.08, w)) AS c FROM w)
 {SEL}, {qnum("CASE WHEN n > 3 THEN coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY ts), 0), 0) ELSE 0 END", "weight")} FROM c"""))
def weights_beta_neutral(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", (F.col("close") - 105).alias("al"), (F.col("volume") / 25).alias("be"))
    df = tb.with_group_size(df, ["ts"], "n")
    # below four names nothing but rounding is left after two projections: their weights are 0
    df = pf.beta_neutral(df, ["ts"], "al", "be", "weight")
    return df.select("symbol", text("ts"), num(F.when(F.col("n") > 3, F.col("weight")).otherwise(0.0)).alias("weight"))


@query("weights_smoothed", "B7 W21", with_ctes("bars", f"""a AS (SELECT symbol, ts, row_number() OVER ({P}) AS rn, close - 105 AS w FROM bars), """ + ewm_sql("a", {"e": ("w", 0.65)}) + f"""
 {SEL}, {qnum("coalesce(e / nullif(sum(abs(e)) OVER (PARTITION BY ts), 0), 0)", "weight")} FROM a JOIN ew USING (symbol, rn)"""))
def weights_smoothed(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", (F.col("close") - 105).alias("w"))
    return pf.smoothed(df, ["ts"], "w", "weight", 0.35, checked(df)).select("symbol", text("ts"), num("weight").alias("weight"))


@query("weights_softmax_score", "B32 B33", with_ctes("bars", f"""a AS (SELECT symbol, ts, (close - 105) / 5 AS p, close AS s FROM bars),
 m AS (SELECT *, exp(10 * p) / sum(exp(10 * p)) OVER d AS sm, (s - avg(s) OVER d) / sqrt(var_pop(s) OVER d + 1e-8) AS z, count(*) OVER d AS n FROM a WINDOW d AS (PARTITION BY ts)),
 g AS (SELECT *, greatest(z, 0) AS pz, sum(greatest(z, 0)) OVER (PARTITION BY ts) AS ps FROM m)
 {SEL}, {qnum("sm", "softmax")}, {qnum("0.7::DOUBLE * CASE WHEN ps > 1e-8 THEN pz / (ps + 1e-8) ELSE 1 / (n + 1e-8) END", "scored")}, {qnum("0.3::DOUBLE", "cash")} FROM g"""))
def weights_softmax_score(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", ((F.col("close") - 105) / 5).alias("p"), F.col("close").alias("s"))
    df = pf.softmax_weights(df, ["ts"], "p", "softmax")
    df = pf.score_weights(df, ["ts"], "s", F.lit(0.7), "scored")
    return df.select("symbol", text("ts"), *nums("softmax", "scored", "cash"))


@query("risk_parity_prior", "B2 B35 B36", with_ctes("bars nb", f"""s AS (SELECT symbol, stddev_samp(ret) AS sd, avg(ret) AS mu, avg(ret) / (stddev_samp(ret) + 1e-8) AS q FROM nb GROUP BY symbol),
 m AS (SELECT symbol, avg(ret) * sqrt(252) AS mom FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM nb) WHERE k <= 60 GROUP BY symbol)
 SELECT symbol, {qnum("(1 / sd) / sum(1 / sd) OVER ()", "risk_parity")},
 {qnum("0.6::DOUBLE * mu + 0.25::DOUBLE * (mom - min(mom) OVER ()) / (max(mom) OVER () - min(mom) OVER () + 1e-8) + 0.15::DOUBLE * (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER () + 1e-8)", "composite")} FROM s JOIN m USING (symbol)"""))
def risk_parity_prior(spark, d):
    from tidemark.operators.experiments import composite_score

    df = returns(spark, d)
    s = composite_score(df, "ret", 60).withColumn("_all", F.lit("all"))
    s = pf.risk_parity(s, ["_all"], "sd", "risk_parity")
    return s.select("symbol", *nums("risk_parity", "composite"))


@query("market_implied_prior", "B35", with_ctes("bars", f"""c AS (SELECT CAST(symbol AS INTEGER) AS k, date_trunc('week', ts) AS wk, avg(close) AS x FROM bars GROUP BY 1, 2),
 w AS (SELECT k, count(*) / sum(count(*)) OVER () AS w FROM c GROUP BY k), a AS (SELECT k, wk, x - avg(x) OVER (PARTITION BY k) AS x FROM c),
 p AS (SELECT wk, sum(w * x) AS p FROM a JOIN w USING (k) GROUP BY wk)
 SELECT CAST(k AS VARCHAR) AS symbol, {qnum("2.5::DOUBLE * sum(x * p) / (count(*) - 1)", "prior")} FROM a JOIN p USING (wk) GROUP BY k HAVING count(*) > 1"""))
def market_implied_prior(spark, d):
    from tidemark.operators.experiments import implied_prior

    weekly = b.bars(spark, d).groupBy(F.col("symbol").cast("int").alias("k"), F.date_trunc("week", "ts").alias("at")).agg(F.avg("close").alias("x"))
    counts = weekly.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("_all", F.lit("all"))
    w = pf.shares(counts, ["_all"], {"w": F.col("n")}).select("k", "w")
    return implied_prior(weekly, w, "x", 2.5).select(F.col("key").cast("string").alias("symbol"), num("prior").alias("prior"))


# --- back-tests ------------------------------------------------------------------------------

W12SQL = """hd AS (SELECT u, strategy, ts, symbol, weight FROM wts),
 dys AS (SELECT u, strategy, ts, row_number() OVER (PARTITION BY u, strategy ORDER BY ts) AS di FROM (SELECT DISTINCT u, strategy, ts FROM hd)),
 nm AS (SELECT DISTINCT u, strategy, symbol FROM hd),
 grid AS (SELECT nm.u, nm.strategy, nm.symbol, dys.ts, dys.di, coalesce(h.weight, 0) AS w FROM nm JOIN dys USING (u, strategy) LEFT JOIN hd h USING (u, strategy, symbol, ts)),
 lagd AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY u, strategy, symbol ORDER BY di), 0) AS wl FROM grid),
 trn AS (SELECT *, abs(wl - lag(wl) OVER (PARTITION BY u, strategy, symbol ORDER BY di)) AS dw FROM lagd),
 perf AS (SELECT u, strategy, trn.ts, sum(wl * coalesce(nb.ret, 0)) AS gross_return, coalesce(sum(dw), 0) AS turnover, sum(abs(wl)) AS gross, sum(wl) AS net
   FROM trn LEFT JOIN nb ON nb.symbol = trn.symbol AND nb.ts = trn.ts GROUP BY 1, 2, 3),
 eq AS (SELECT *, turnover * 0.0005 AS cost, gross_return - turnover * 0.0005 AS r,
   exp(sum(ln(1 + gross_return - turnover * 0.0005)) OVER (PARTITION BY u, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM perf)"""


@query("weight_backtest_curve", "B12 B31 B17", with_ctes("bars nb", """wts AS (SELECT asset_group AS u, 'eq' AS strategy, ts, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY asset_group, ts) AS weight FROM bars), """ + W12SQL
 + " SELECT u AS universe, CAST(ts AS VARCHAR) AS ts, " + qnums("gross_return", "turnover", "gross", "net", "cost", "equity") + ", " + qnum("r", "net_return") + " FROM eq"))
def weight_backtest_curve(spark, d):
    df = returns(spark, d).withColumnRenamed("asset_group", "universe")
    w = pf.equal_weight(df, ["universe", "ts"], F.lit(True), "eq")
    days = bt.panel_dates(b.bars(spark, d).select(F.col("asset_group").alias("universe"), "ts"), ["universe"])
    perf = bt.weight_backtest(w, ["eq"], ["universe"], days=days)
    return perf.select("universe", text("ts"), *nums("gross_return", "turnover", "gross", "net", "cost", "equity"), num("return").alias("net_return"))


FLAG = """lv AS (SELECT *, CASE WHEN lower(asset_group) = 'asia' THEN 365.0::DOUBLE ELSE 252.0::DOUBLE END AS py, ln(open / pc) AS ovn, ln(close / open) AS co,
  greatest(ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close), 0) AS rs, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS mom0 FROM nb),
 vv AS (SELECT *, CASE WHEN count(ovn) OVER k >= 10 THEN sqrt(py * greatest(var_samp(ovn) OVER k + (0.34 / (1.34 + 21.0::DOUBLE / 19)) * var_samp(co) OVER k + (1 - 0.34 / (1.34 + 21.0::DOUBLE / 19)) * avg(rs) OVER k, 0)) END AS vol0,
  CASE WHEN count(lr) OVER k >= 10 THEN stddev_samp(lr) OVER k * sqrt(py) END AS rv FROM lv WINDOW k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 ed AS (SELECT symbol, quantile_cont(rv, 1.0::DOUBLE / 3) AS e1, quantile_cont(rv, 2.0::DOUBLE / 3) AS e2 FROM vv GROUP BY symbol),
 rg AS (SELECT vv.*, CASE WHEN rv < e1 THEN 'calm' WHEN rv < e2 THEN 'neutral' WHEN rv >= e2 THEN 'stress' END AS reg0 FROM vv JOIN ed USING (symbol)),
 fr AS (SELECT asset_group, symbol, ts, ret, last_value(vol0 IGNORE NULLS) OVER a AS vol, last_value(reg0 IGNORE NULLS) OVER a AS regime, last_value(mom0 IGNORE NULLS) OVER a AS mom FROM rg
   WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 mdn AS (SELECT symbol, quantile_cont(vol, 0.5) AS md FROM fr GROUP BY symbol),
 un AS (SELECT asset_group AS u, fr.*, md FROM fr JOIN mdn USING (symbol) UNION ALL SELECT 'all_assets', fr.*, md FROM fr JOIN mdn USING (symbol)),
 mk AS (SELECT *, CASE WHEN coalesce(regime IN ('calm', 'neutral'), false) THEN 1.0::DOUBLE ELSE 0 END AS onn, CASE regime WHEN 'calm' THEN 1.0::DOUBLE WHEN 'neutral' THEN 0.6 WHEN 'stress' THEN 0.2 ELSE 0 END AS sc FROM un),
 m2 AS (SELECT *, coalesce(onn / nullif(vol, 0), 0) AS iv, CASE WHEN coalesce(mom > 0, false) THEN onn ELSE 0 END AS mo FROM mk),
 m3 AS (SELECT *, 1.0::DOUBLE / count(*) OVER d AS w1, coalesce(onn / nullif(sum(onn) OVER d, 0), 0) AS w2, sc / count(*) OVER d AS w3, coalesce(iv / nullif(sum(iv) OVER d, 0), 0) AS w4, coalesce(mo / nullif(sum(mo) OVER d, 0), 0) AS w5 FROM m2 WINDOW d AS (PARTITION BY u, ts)),
 m4 AS (SELECT *, sum(w4 * coalesce(vol, md)) OVER (PARTITION BY u, ts) AS wv FROM m3),
 wts AS (SELECT u, ts, symbol, unnest(['buy_hold_equal_weight', 'regime_long_flat', 'regime_scaled_cash', 'inverse_vol_target', 'momentum_filter', 'iv_overlay']) AS strategy,
   unnest([w1, w2, w3, CASE WHEN wv > 0 THEN w4 * least(0.15::DOUBLE / wv, 1.5) ELSE 0 END, w5, w2]) AS weight FROM m4), """ + W12SQL
FLAG_METRICS = """, ddn AS (SELECT *, equity / max(equity) OVER (PARTITION BY u, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, CASE WHEN lower(u) = 'asia' THEN 365.0::DOUBLE ELSE 252.0::DOUBLE END AS py FROM eq),
 ag AS (SELECT u, strategy, count(*) AS days, arg_max(equity, ts) AS fin, max(py) AS py, avg(r) AS m, stddev_pop(r) AS s, stddev_pop(CASE WHEN r < 0 THEN r END) AS dn, min(dd) AS max_drawdown,
   avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, avg(turnover) AS avg_turnover, avg(gross) AS avg_gross, sum(cost) AS total_cost FROM ddn GROUP BY u, strategy)
 SELECT u AS universe, strategy, days, """ + qnum("fin - 1", "total_return") + ", " + qnum("pow(fin, py / days) - 1", "cagr") + ", " + qnum("s * sqrt(py)", "annual_vol") + ", " + qnum("m / s * sqrt(py)", "sharpe") + ", " \
 + qnum("m / nullif(dn, 0) * sqrt(py)", "sortino") + ", " + qnum("(pow(fin, py / days) - 1) / abs(max_drawdown)", "calmar") + ", " + qnums("max_drawdown", "hit_rate", "avg_turnover", "avg_gross", "total_cost") + " FROM ag"
METRIC_COLS = ("total_return", "cagr", "annual_vol", "sharpe", "sortino", "calmar", "max_drawdown", "hit_rate", "avg_turnover", "avg_gross", "total_cost")


@query("regime_universe_comparison", "B12 B14 B15 B21 A18 R5 V7 J6", with_ctes("bars nb", FLAG + FLAG_METRICS))
def regime_universe_comparison(spark, d):
    metrics, _ = compare(b.bars(spark, d), OPEN_GROUP)
    return metrics.select("universe", "strategy", "days", *nums(*METRIC_COLS))


@query("excess_over_benchmark", "J16 X12", with_ctes("bars nb", FLAG + f""", ag AS (SELECT u, strategy, arg_max(equity, ts) - 1 AS tr FROM eq GROUP BY u, strategy)
 SELECT a.u AS universe, a.strategy, {qnum("a.tr", "total_return")}, {qnum("a.tr - z.tr", "excess_return")} FROM ag a JOIN ag z ON z.u = a.u AND z.strategy = 'buy_hold_equal_weight'"""))
def excess_over_benchmark(spark, d):
    from tidemark.operators.experiments import excess

    metrics, _ = compare(b.bars(spark, d), OPEN_GROUP)
    out = excess(metrics, "universe", "strategy", "buy_hold_equal_weight", ["total_return"])
    return out.select("universe", "strategy", num("total_return").alias("total_return"), num("excess_total_return").alias("excess_return"))


SEGMENT = f"""s AS (SELECT *, greatest(-1, least(1, (105 - close) / 5)) AS w, month(ts) * 10000 + year(ts) AS mo FROM nb),
 nd AS (SELECT *, coalesce(mo <> lag(mo) OVER ({P}), true) AS tr FROM s),
 k AS (SELECT *, lag(w) OVER ({P}) AS w0, lag(close) OVER ({P}) AS p0 FROM nd WHERE tr),
 k2 AS (SELECT *, abs(w - coalesce(w0 * (close / p0) / (1 + w0 * (close / p0 - 1)), 0)) AS tau FROM k),
 k3 AS (SELECT *, exp(sum(ln(coalesce(1 - 0.0005::DOUBLE * ltau + w0 * (close / p0 - 1), 1))) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS e FROM (SELECT *, lag(tau) OVER ({P}) AS ltau FROM k2)),
 f AS (SELECT nd.symbol, nd.ts, nd.close, last_value(k3.e IGNORE NULLS) OVER u AS e, last_value(k3.w IGNORE NULLS) OVER u AS w, last_value(k3.close IGNORE NULLS) OVER u AS p0, last_value(k3.tau IGNORE NULLS) OVER u AS tau,
   sum(coalesce(k3.e * k3.tau, 0)) OVER u AS vol, first(nd.close) OVER u AS c0 FROM nd LEFT JOIN k3 ON k3.symbol = nd.symbol AND k3.ts = nd.ts WINDOW u AS (PARTITION BY nd.symbol ORDER BY nd.ts ROWS UNBOUNDED PRECEDING)),
 cv AS (SELECT *, 10000 * e * (1 - 0.0005::DOUBLE * tau + w * (close / p0 - 1)) AS equity, close / c0 * 10000 AS bh FROM f)"""


def target_curve(spark, d):
    df = b.bars(spark, d)
    ax = checked(df)
    df = windowed(df, lambda x, a: x.withColumns({"signal": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (105 - F.col("close")) / 5)), "trades_now": bt.rebalance_mask(a, "monthly")}), ax, lookback=1)
    df = bt.target_backtest(df, ax)
    return bt.buy_and_hold(df, ax, 10_000.0), ax


@query("target_weight_backtest", "B16 B17 W20 B39", with_ctes("bars nb", SEGMENT + f""" {SEL}, {qnum("equity", "equity", 4)}, {qnum("10000 * vol * 0.0004", "fees", 4)}, {qnum("10000 * vol * 0.0001", "slippage", 4)}, {qnum("bh", "bh_equity", 4)} FROM cv"""))
def target_weight_backtest(spark, d):
    df, _ = target_curve(spark, d)
    return df.select("symbol", text("ts"), *nums("equity", "fees", "slippage", "bh_equity", digits=4))


CURVE = SEGMENT + f""", rr AS (SELECT *, coalesce(equity / lag(equity) OVER ({P}) - 1, 0) AS r, coalesce(bh / lag(bh) OVER ({P}) - 1, 0) AS b, equity / max(equity) OVER ({P} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cv),
 g AS (SELECT symbol, count(*) AS n, arg_min(equity, ts) AS f, arg_max(equity, ts) AS l, arg_min(bh, ts) AS bf, arg_max(bh, ts) AS bl, min(dd) AS dd, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(CASE WHEN r < 0 THEN r END) AS ds,
   covar_samp(r, b) AS cov, var_pop(b) AS vp, var_samp(b) AS vs, avg(b) AS bm, stddev_samp(r - b) AS te, sum(r * r) AS yy, sum(r * b) AS xy, sum(b * b) AS xx, var_pop(r) AS vy FROM rr GROUP BY symbol)"""


@query("curve_metrics", "B18 B28", with_ctes("bars nb", CURVE + f""" SELECT symbol, {qnum("l", "final_equity", 4)}, {qnum("(l / f - 1) * 100", "total_return_pct")}, {qnum("(pow(l / f, 252.0::DOUBLE / n) - 1) * 100", "cagr_pct")},
 {qnum("dd * 100", "max_drawdown_pct")}, {qnum("m / s * sqrt(252)", "sharpe")}, {qnum("m / ds * sqrt(252)", "sortino")}, {qnum("(pow(l / f, 252.0::DOUBLE / n) - 1) / abs(dd)", "calmar")},
 {qnum("cov / vp", "capm_beta")}, {qnum("(m - cov / vp * bm) * 25200", "capm_alpha")}, {qnum("(m - bm) / te * sqrt(252)", "info_ratio")} FROM g"""))
def curve_metrics(spark, d):
    df, ax = target_curve(spark, d)
    g = mx.curve_metrics(df, ax, "equity", 252.0, "bh_equity")
    return g.select("symbol", num("final_equity", 4).alias("final_equity"), *nums("total_return_pct", "cagr_pct", "max_drawdown_pct", "sharpe", "sortino", "calmar", "capm_beta", "capm_alpha", "info_ratio"))


@query("alpha_beta_r2", "B19 B20", with_ctes("bars nb", CURVE + f""" SELECT symbol, {qnum("(m - cov / vp * bm) * 25200", "alpha_pct")}, {qnum("cov / vp", "beta")}, {qnum("1 - (yy - 2 * cov / vp * xy + pow(cov / vp, 2) * xx) / (vy * n)", "r_squared")},
 {qnum("(pow(l / f, 252.0::DOUBLE / (n - 1)) - 1) * 100", "annualized_return_pct")}, {qnum("cov / vs", "live_beta")}, {qnum("(m - cov / vs * bm) * 25200", "alpha_annualized_pct")},
 {qnum("(l / f - bl / bf) * 100", "excess_return_pct")}, {qnum("s * sqrt(252) * 100", "volatility_pct")} FROM g"""))
def alpha_beta_r2(spark, d):
    df, ax = target_curve(spark, d)
    df = windowed(df, lambda x, a: x.withColumns({"r": F.coalesce(pct_change("equity", a), F.lit(0.0)), "bb": F.coalesce(pct_change("bh_equity", a), F.lit(0.0))}), ax, lookback=1)
    left = mx.alpha_beta(df, ["symbol"], "r", "bb")
    right = mx.live_metrics(df, ax, "equity", "bh_equity").withColumnRenamed("beta", "live_beta")
    return left.join(right, "symbol").select("symbol", *nums("alpha_pct", "beta", "r_squared", "annualized_return_pct", "live_beta", "alpha_annualized_pct", "excess_return_pct", "volatility_pct"))


@query("compact_and_benchmark_stats", "B22 B23 A16 B10", with_ctes("bars nb", f"""m AS (SELECT symbol, ret, coalesce(ret, 0) AS y, avg(ret) OVER (PARTITION BY ts) AS mk FROM nb), x AS (SELECT *, coalesce(mk, 0) AS x FROM m),
 g AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + y))) - 1 AS total, stddev_pop(y) * sqrt(252) AS vol, var_pop(x) AS vx, covar_pop(y, x) / var_pop(x) AS beta, avg(y) AS my, avg(x) AS mx, stddev_pop(y - x) * sqrt(252) AS te, corr(y, x) AS c, avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM x GROUP BY symbol)
 SELECT symbol, {qnum("total", "total")}, {qnum("vol", "vol")}, {qnum("pow(1 + total, 252.0::DOUBLE / n) - 1", "annual")}, {qnum("(pow(1 + total, 252.0::DOUBLE / n) - 1) / vol", "sharpe")}, {qnum("te", "tracking_error")}, {qnum("(my - mx) * 252 / te", "info_ratio")},
 {qnum("beta", "beta")}, {qnum("(my - beta * mx) * 252", "alpha_annual")}, {qnum("c", "correlation")}, {qnum("hit", "hit_rate")} FROM g"""))
def compact_and_benchmark_stats(spark, d):
    df = market(returns(spark, d))
    return mx.compact_stats(df, ["symbol"], "ret").join(mx.benchmark_stats(df, ["symbol"], "ret", "mkt"), "symbol").select(
        "symbol", *nums("total", "vol", "annual", "sharpe", "tracking_error", "info_ratio", "beta", "alpha_annual", "correlation", "hit_rate"))


@query("rolling_risk", "B24", with_ctes("bars nb", f"""m AS (SELECT *, coalesce(ret, 0) AS y, coalesce(avg(ret) OVER (PARTITION BY ts), 0) AS x FROM nb),
 w AS (SELECT *, count(*) OVER k AS n, covar_pop(y, x) OVER k / nullif(var_pop(x) OVER k, 0) AS be, avg(y) OVER k AS my, avg(x) OVER k AS mx FROM m WINDOW k AS ({P} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
 {SEL}, {qnum("CASE WHEN n >= 63 THEN be END", "roll_beta")}, {qnum("CASE WHEN n >= 63 THEN (my - be * mx) * 252 END", "roll_alpha")}, {qnum(f"({roll('avg', 'y', 63)}) / nullif(({roll('stddev_samp', 'y', 63)}), 0) * sqrt(252)", "roll_sharpe")},
 {qnum(roll("corr(y, {x})", "x", 90), "roll_corr")} FROM w"""))
def rolling_risk(spark, d):
    df = market(returns(spark, d)).withColumns({"y": F.coalesce("ret", F.lit(0.0)), "x": F.coalesce("mkt", F.lit(0.0))})
    df = df.select("symbol", "ts", "y", "x")
    df = windowed(df, lambda q, a: with_frames(q, a, mx.rolling_alpha_beta("y", "x"), mx.rolling_sharpe("y"), mx.rolling_corr("y", "x")), lookback=90)
    return df.select("symbol", text("ts"), *nums("roll_beta", "roll_alpha", "roll_sharpe", "roll_corr"))


@query("beta_hedge", "B25", with_ctes("bars nb", f"""m AS (SELECT *, coalesce(ret, 0) AS y, coalesce(avg(ret) OVER (PARTITION BY ts), 0) AS x FROM nb),
 w AS (SELECT *, CASE WHEN count(*) OVER k >= 20 THEN covar_samp(y, x) OVER k / nullif(var_samp(x) OVER k, 0) END AS be FROM m WINDOW k AS ({P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, coalesce(lag(be) OVER ({P}), 0) AS bl FROM w), a AS (SELECT *, y - bl * x AS alpha FROM h),
 v AS (SELECT *, {roll("stddev_samp", "alpha", 20, 10)} * sqrt(252) AS av FROM a), s AS (SELECT *, CASE WHEN av > 0 THEN greatest(0.5, least(2, 0.1::DOUBLE / av)) END AS sc FROM v)
 {SEL}, {qnum("bl * x", "beta_component")}, {qnum("alpha", "alpha_component")}, {qnum("y - (bl - 0.2::DOUBLE) * x", "beta_target")}, {qnum(f"alpha * coalesce(lag(sc) OVER ({P}), 1)", "alpha_vol_target")} FROM s"""))
def beta_hedge(spark, d):
    from tidemark.operators.experiments import beta_hedge as hedge

    df = market(returns(spark, d)).withColumns({"y": F.coalesce("ret", F.lit(0.0)), "x": F.coalesce("mkt", F.lit(0.0))})
    df = windowed(df, lambda q, a: hedge(q, a, "y", "x"), lookback=90)
    return df.select("symbol", text("ts"), *nums("beta_component", "alpha_component", "beta_target", "alpha_vol_target"))


@query("tail_risk", "B27", with_ctes("bars nb", f"""q AS (SELECT symbol, quantile_cont(ret, 0.05) AS v FROM nb GROUP BY symbol)
 SELECT symbol, {qnum("max(v)", "var")}, {qnum("avg(CASE WHEN ret <= v THEN ret END)", "shortfall")}, {qnum("skewness(ret)", "skew")}, {qnum("kurtosis(ret)", "kurt")} FROM nb JOIN q USING (symbol) GROUP BY symbol"""))
def tail_risk(spark, d):
    return mx.tail_risk(returns(spark, d), ["symbol"], "ret").select("symbol", *nums("var", "shortfall", "skew", "kurt"))


@query("high_low_vol_split", "V14", with_ctes("bars nb", f"""v AS (SELECT *, {roll("stddev_samp", "ret", 20)} AS vol FROM nb), md AS (SELECT symbol, quantile_cont(vol, 0.5) AS md FROM v GROUP BY symbol)
 SELECT symbol, vol > md AS high_vol, count(*) AS n, {qnum("avg(ret) * 252", "annual_mean")}, {qnum("stddev_samp(ret) * sqrt(252)", "annual_vol")} FROM v JOIN md USING (symbol) WHERE vol IS NOT NULL GROUP BY symbol, vol > md"""))
def high_low_vol_split(spark, d):
    df = windowed(returns(spark, d), lambda x, a: x.withColumn("vol", roll_std("ret", a, 20)), lookback=20).where("vol IS NOT NULL")
    df = df.join(df.groupBy("symbol").agg(F.percentile("vol", F.lit(0.5)).alias("md")), "symbol")
    return df.groupBy("symbol", (F.col("vol") > F.col("md")).alias("high_vol")).agg(F.count(F.lit(1)).alias("n"), num(F.avg("ret") * 252).alias("annual_mean"), num(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("annual_vol"))


ATRQ = "n2 AS (SELECT *, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM nb), " + ewm_sql("n2", {"a14": ("tr", wilder(14))}) + f""",
 j AS (SELECT n2.*, CASE WHEN rn >= 14 THEN a14 END AS atr FROM n2 JOIN ew USING (symbol, rn)),
 sg AS (SELECT symbol, ts, rn, 'long' AS direction, close AS ep, atr FROM j WHERE close < 102 AND atr IS NOT NULL UNION ALL SELECT symbol, ts, rn, 'short', close, atr FROM j WHERE close > 108 AND atr IS NOT NULL),
 en AS (SELECT *, ep - CASE WHEN direction = 'long' THEN 1 ELSE -1 END * atr * 1.5::DOUBLE AS sp, ep + CASE WHEN direction = 'long' THEN 1 ELSE -1 END * atr * 2 AS tp FROM sg),
 pt AS (SELECT en.*, j.rn AS xr, j.high AS h, j.low AS l, j.close AS c FROM en JOIN j ON j.symbol = en.symbol AND j.rn BETWEEN en.rn AND en.rn + 20),
 ht AS (SELECT *, xr > rn AND CASE WHEN direction = 'long' THEN l <= sp ELSE h >= sp END AS hs, xr > rn AND CASE WHEN direction = 'long' THEN h >= tp ELSE l <= tp END AS hp FROM pt),
 ex AS (SELECT symbol, ts, rn, direction, ep, sp, tp, min(CASE WHEN hs OR hp THEN xr END) AS hx, max(xr) AS lx, arg_max(c, xr) AS lc, arg_min(hs, CASE WHEN hs OR hp THEN xr END) AS st FROM ht GROUP BY ALL),
 td AS (SELECT *, coalesce(hx, lx) AS xr, CASE WHEN hx IS NULL THEN 'time' WHEN st THEN 'stop' ELSE 'target' END AS why, CASE WHEN hx IS NULL THEN lc WHEN st THEN sp ELSE tp END AS xp FROM ex),
 tp AS (SELECT *, 100 * (xp / ep - 1) * CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS pnl FROM td)"""


def bracket_trades(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "high", "low", "close")
    ax = checked(bars)
    bars = positions(bars, ax)
    df = ind.add_atr(bars, ax)
    side = F.when(F.col("close") < 102, "long").when(F.col("close") > 108, "short")
    en = df.withColumn("direction", side).where("direction IS NOT NULL AND atr IS NOT NULL").withColumn("entry_price", F.col("close"))
    en = en.withColumns(bt.bracket_levels(F.col("direction"), F.col("entry_price"), F.col("atr"), 1.5, 2.0))
    return bt.first_touch(en.select("symbol", "rn", "direction", "entry_price", "stop_price", "target_price"), bars, 20, ax), ax


@query("first_touch_exits", "B9 B11 J13", with_ctes("bars nb", ATRQ + f""" SELECT symbol, rn - 1 AS entry_rn, direction, xr - 1 AS exit_rn, why AS exit_reason, {qnum("sp", "stop_price")}, {qnum("tp", "target_price")}, {qnum("xp", "exit_price")}, {qnum("pnl", "pnl")} FROM tp"""))
def first_touch_exits(spark, d):
    t, _ = bracket_trades(spark, d)
    return t.select("symbol", F.col("rn").alias("entry_rn"), "direction", "exit_rn", "exit_reason", *nums("stop_price", "target_price", "exit_price", "pnl"))


@query("trade_summary", "B26", with_ctes("bars nb", ATRQ + f""" SELECT coalesce(direction, 'all') AS direction, coalesce(why, 'all') AS exit_reason, count(*) AS trades, {qnum("100 * avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)", "win_rate")}, {qnum("avg(pnl)", "mean_pnl")},
 {qnum("sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl <= 0 THEN pnl END))", "profit_factor")}, CAST(sum(xr - rn) AS BIGINT) AS bars_in_market FROM tp GROUP BY GROUPING SETS ((direction, why), ())"""))
def trade_summary(spark, d):
    t, _ = bracket_trades(spark, d)
    g = mx.trade_metrics(t, ["direction", "exit_reason"])
    return g.select(F.coalesce("direction", F.lit("all")).alias("direction"), F.coalesce("exit_reason", F.lit("all")).alias("exit_reason"), "trades", *nums("win_rate", "mean_pnl", "profit_factor"), "bars_in_market")


@query("one_open_trade", "B10 scan", with_ctes("bars nb", ATRQ + f""", o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn, direction) AS k FROM tp),
 r AS (SELECT symbol, k, rn, xr, pnl, true AS taken, xr AS busy FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.k, o.rn, o.xr, o.pnl, o.rn > r.busy, CASE WHEN o.rn > r.busy THEN o.xr ELSE r.busy END FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1)
 SELECT symbol, xr - 1 AS exit_rn, {qnum("100 * exp(sum(ln(1 + pnl / 100)) OVER (PARTITION BY symbol ORDER BY xr ROWS UNBOUNDED PRECEDING))", "equity")} FROM r WHERE taken"""))
def one_open_trade(spark, d):
    t, ax = bracket_trades(spark, d)
    t = t.select("symbol", "rn", "direction", "exit_rn", "pnl")
    return bt.trade_equity(bt.one_at_a_time(t, ax), ax).select("symbol", "exit_rn", num("equity").alias("equity"))


@query("worst_case_report", "B29 A10 A5", with_ctes("bars nb", f"""e AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS eq FROM nb),
 s AS (SELECT asset_group, symbol, CAST(symbol AS INTEGER) AS k, arg_max(eq, ts) - 1 AS tr, avg(ret) / stddev_samp(ret) * sqrt(252) AS sh FROM e GROUP BY 1, 2)
 SELECT asset_group, arg_min(symbol, tr) AS worst_return_symbol, {qnum("min(tr)", "worst_return")}, arg_min(symbol, sh) AS worst_sharpe_symbol, {qnum("min(sh)", "worst_sharpe")}, count(*) FILTER (tr < 0) AS losing, count(*) FILTER (sh < -0.5) AS excluded FROM s GROUP BY asset_group"""))
def worst_case_report(spark, d):
    from tidemark.operators.experiments import worst_case

    df = returns(spark, d)
    stats = mx.compact_stats(df, ["asset_group", "symbol"], "ret").drop("sharpe").join(
        df.groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe")), "symbol")
    return worst_case(stats, ["asset_group"]).select("asset_group", "worst_return_symbol", num("worst_return").alias("worst_return"), "worst_sharpe_symbol", num("worst_sharpe").alias("worst_sharpe"), "losing", "excluded")


@query("rebalance_intents", "B37 B38", with_ctes("bars nb", f"""s AS (SELECT *, greatest(0, least(0.25, (105 - close) / 5)) AS tgt, lag(close) OVER ({P}) AS entry, 10 * (lag(close) OVER ({P}) - 100) AS qty FROM nb),
 i AS (SELECT *, tgt * 10000 / close - qty AS dq FROM s WHERE qty IS NOT NULL)
 {SEL}, {qnum("dq", "quantity")}, CASE WHEN dq > 0 THEN 'buy' ELSE 'sell' END AS side, {qnum("abs(dq) * close", "notional", 4)}, CASE WHEN close / entry - 1 <= -0.05 THEN 'stop_loss' WHEN close / entry - 1 >= 0.05 THEN 'take_profit' ELSE 'none' END AS exit_rule
 FROM i WHERE abs(dq) >= 0.5 AND abs(dq) * close >= 100"""))
def rebalance_intents(spark, d):
    from tidemark.operators.experiments import intents

    df = windowed(b.bars(spark, d), lambda x, a: x.withColumn("entry_price", prev("close", a)), lookback=1)
    df = df.withColumns({"signal": (105 - F.col("close")) / 5, "quantity": 10 * (F.col("entry_price") - 100), "equity": F.lit(10000.0)}).where("quantity IS NOT NULL")
    out = intents(df, max_weight=0.25, min_quantity=0.5, min_notional=100.0, stop_loss=0.05, take_profit=0.05)
    return out.select("symbol", text("ts"), num("order_quantity").alias("quantity"), "side", num("notional", 4).alias("notional"), "exit_rule")


@query("top_holdings", "A23 P23 B1", with_ctes("bars", f"""w AS (SELECT symbol, volume / sum(volume) OVER (PARTITION BY ts) AS w FROM bars), m AS (SELECT symbol, avg(w) AS m FROM w GROUP BY symbol HAVING avg(w) > 0)
 SELECT symbol, {qnum("m", "mean_weight")} FROM m ORDER BY m DESC, symbol LIMIT 20"""))
def top_holdings(spark, d):
    w = pf.shares(b.bars(spark, d).select("symbol", "ts", "volume"), ["ts"], {"w": F.col("volume")})
    m = w.groupBy("symbol").agg(F.avg("w").alias("m")).where("m > 0")
    return m.orderBy(F.desc("m"), "symbol").limit(20).select("symbol", num("m").alias("mean_weight"))
