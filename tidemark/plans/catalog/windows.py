"""Generic windows, window-only indicators and volatility estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cleaning import correlation
from tidemark.operators import indicators as ind
from tidemark.operators import volatility as vol
from tidemark.operators.frames import Frame, framed, with_frames
from tidemark.operators.passes import with_parts
from tidemark.operators.recurrences import decayed_sum, ewm_mean, ewm_std, span, wilder
from tidemark.operators.series import (
    BARS,
    Axis,
    checked,
    following,
    log_return,
    pct_change,
    prev,
    roll_max,
    roll_mean,
    roll_min,
    roll_quantile,
    roll_std,
    roll_sum,
    roll_var,
    running,
    windowed,
)
from tidemark.plans.registry import ewm_sql, num, nums, qnum, qnums, query, text, with_ctes
from tidemark.sources import bindings as b

P = "PARTITION BY symbol ORDER BY ts"


def frame(n: int, part: str = P) -> str:
    return f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """Gated rolling aggregate; ``agg`` may hold ``{x}``."""
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n if least is None else least} THEN {call} OVER {frame(n)} END"


def day_keys(df, *cols):
    return df.select("symbol", text("ts"), *cols)


SEL = "SELECT symbol, CAST(ts AS VARCHAR) AS ts"


@query("lag_lead_change", "W1 W2 I13", with_ctes("bars", f"""{SEL},
 {qnum("lag(close, 1) OVER w", "lag1")}, {qnum("lead(close, 2) OVER w", "lead2")},
 {qnum("close - lag(close) OVER w", "diff1")}, {qnum("close / lag(close, 5) OVER w - 1", "pct5")},
 {qnum("lead(close) OVER w / close - 1", "fwd_ret")}, {qnum("close - lag(close, 10) OVER w", "momentum_10")},
 {qnum("100 * (close / lag(close, 10) OVER w - 1)", "roc_10")} FROM bars WINDOW w AS ({P})"""))
def lag_lead_change(spark, d):
    df = windowed(
        b.bars(spark, d),
        lambda x, a: x.withColumns({
            "lag1": prev("close", a), "lead2": following("close", a, 2), "diff1": F.col("close") - prev("close", a),
            "pct5": pct_change("close", a, 5), "fwd_ret": following("close", a) / F.col("close") - 1,
            "momentum_10": ind.momentum("close", a, 10), "roc_10": ind.roc("close", a, 10),
        }),
        lookback=10, lookahead=2,
    )
    return day_keys(df, *nums("lag1", "lead2", "diff1", "pct5", "fwd_ret", "momentum_10", "roc_10"))


@query("rolling_basic", "W3 W4 I1", with_ctes("bars", f"""r AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret FROM bars)
 {SEL}, {qnum(roll("avg", "close", 20), "mean_20")}, {qnum(roll("sum", "volume", 10, 5), "vsum_10")},
 {qnum(roll("min", "low", 14), "low_14")}, {qnum(roll("max", "high", 14), "high_14")},
 {qnum(roll("stddev_samp", "ret", 20), "std_20")}, {qnum(roll("var_samp", "close", 10), "var_10")},
 {qnum(roll("covar_samp(close, {x})", "volume", 30), "cov_30")}, {qnum(roll("corr(close, {x})", "volume", 30), "corr_30")},
 {qnum(roll("avg", "close", 50), "sma_50")} FROM r"""))
def rolling_basic(spark, d):
    def add(x, a):
        x = x.withColumn("ret", pct_change("close", a))
        return framed(x, {
            "mean_20": Frame("mean", "close", 20, 20), "vsum_10": Frame("sum", "volume", 10, 5), "low_14": Frame("min", "low", 14, 14),
            "high_14": Frame("max", "high", 14, 14), "std_20": Frame("std_samp", "ret", 20, 20), "var_10": Frame("var_samp", "close", 10, 10),
            "cov_30": Frame("covar_samp", ("close", "volume"), 30, 30, gate="volume"), "corr_30": Frame("corr", ("close", "volume"), 30, 30, gate="volume"),
            "sma_50": Frame("mean", "close", 50, 50),
        }, a)

    df = windowed(b.bars(spark, d).select("symbol", "ts", "high", "low", "close", "volume"), add, lookback=50)
    return day_keys(df, *nums("mean_20", "vsum_10", "low_14", "high_14", "std_20", "var_10", "cov_30", "corr_30", "sma_50"))


@query("rolling_quantile_median", "W5", with_ctes("bars", f"""{SEL},
 {qnum(roll("quantile_cont({x}, 0.9)", "close", 60, 20), "q90_60")},
 {qnum(roll("quantile_cont({x}, 0.5)", "volume", 20), "median_20")} FROM bars"""))
def rolling_quantile_median(spark, d):
    df = windowed(
        b.bars(spark, d),
        lambda x, a: x.withColumns({"q90_60": roll_quantile("close", 0.9, a, 60, 20), "median_20": roll_quantile("volume", 0.5, a, 20)}),
        lookback=60,
    )
    return day_keys(df, *nums("q90_60", "median_20"))


def wma_sql(x: str, n: int) -> str:
    lags = " + ".join(f"{n - k} * lag({x}, {k}) OVER ({P})" for k in range(n))
    return f"({lags}) / {n * (n + 1) / 2}"


@query("weighted_means", "W6 I3 I4 I5 I6", with_ctes("bars", f"""
 a AS (SELECT *, 2 * ({wma_sql("close", 8)}) - ({wma_sql("close", 16)}) AS raw,
   2 * ({roll("avg", "close", 8)}) - ({roll("avg", "close", 16)}) AS raw2 FROM bars)
 {SEL}, {qnum(wma_sql("close", 9), "wma_9")}, {qnum(wma_sql("raw", 4), "hma_16")}, {qnum(roll("avg", "raw2", 4), "hma_sma_16")},
 {qnum(f"({roll('sum', 'close * volume', 20)}) / ({roll('sum', 'volume', 20)})", "vwma_20")} FROM a"""))
def weighted_means(spark, d):
    def add(x, a):
        x = ind.add_hma(x, a, 16, "hma_16")
        x = ind.add_hma_sma(x, a, 16, "hma_sma_16")
        return x.withColumns({"wma_9": ind.wma("close", a, 9), "vwma_20": ind.vwma("close", "volume", a, 20)})

    return day_keys(windowed(b.bars(spark, d), add, lookback=40), *nums("wma_9", "hma_16", "hma_sma_16", "vwma_20"))


@query("rolling_mad_cci", "W7 I17", with_ctes("bars", f"""tp AS (SELECT *, (high + low + close) / 3 AS t,
   row_number() OVER ({P}) AS rn FROM bars),
 m AS (SELECT *, avg(t) OVER {frame(20)} AS ma FROM tp),
 dev AS (SELECT a.symbol, a.rn, avg(abs(x.t - a.ma)) AS mad FROM m a JOIN tp x ON x.symbol = a.symbol
   AND x.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20 GROUP BY ALL)
 {SEL}, {qnum("mad", "mad_20")}, {qnum("(t - ma) / (0.015 * nullif(mad, 0))", "cci_20")} FROM m LEFT JOIN dev USING (symbol, rn)"""))
def rolling_mad_cci(spark, d):
    def add(x, a):
        x = x.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        return x.withColumns({"mad_20": ind.mean_abs_deviation("_tp", a, 20), "cci_20": ind.cci(a, 20)})

    return day_keys(windowed(b.bars(spark, d), add, lookback=20), *nums("mad_20", "cci_20"))


@query("rolling_rank_last", "W8", with_ctes("bars", f"""s AS (SELECT *, row_number() OVER ({P}) AS rn FROM bars)
 SELECT a.symbol, CAST(a.ts AS VARCHAR) AS ts, {qnum("count(*) FILTER (x.close < a.close) / count(*)", "rank_60")}
 FROM s a JOIN s x ON x.symbol = a.symbol AND x.rn BETWEEN a.rn - 59 AND a.rn WHERE a.rn >= 60 GROUP BY a.symbol, a.ts"""))
def rolling_rank_last(spark, d):
    from tidemark.operators.signals import rank_of_last

    df = windowed(b.bars(spark, d).select("symbol", "ts", "close"), lambda x, a: framed(x, {"rank_60": rank_of_last("close", 60)}, a), lookback=60)
    return day_keys(df.where("rank_60 IS NOT NULL"), num("rank_60").alias("rank_60"))


@query("expanding_aggregates", "W9 W10", with_ctes("bars nb", f"""{SEL},
 {qnum("sum(volume) OVER u", "cum_volume")}, {qnum("max(close) OVER u", "peak")}, {qnum("min(close) OVER u", "trough")},
 {qnum("exp(sum(ln(1 + coalesce(ret, 0))) OVER u)", "equity")},
 {qnum("exp(sum(ln(1 + coalesce(ret, 0))) OVER u) * first(close) OVER u / max(close) OVER u - 1", "drawdown")}
 FROM nb WINDOW u AS ({P} ROWS UNBOUNDED PRECEDING)"""))
def expanding_aggregates(spark, d):
    from tidemark.operators.backtest import compound

    df = windowed(b.bars(spark, d), lambda x, a: x.withColumn("ret", pct_change("close", a)), lookback=1)
    ax = checked(df)
    df = running(df, {"cum_volume": ("sum", "volume"), "peak": ("max", "close"), "trough": ("min", "close"),
                      "first_close": ("first", "close"), "_log": ("sum", compound("ret"))}, ax)
    df = df.withColumn("equity", F.exp("_log"))
    df = df.withColumn("drawdown", F.col("equity") * F.col("first_close") / F.col("peak") - 1)
    return day_keys(df, *nums("cum_volume", "peak", "trough", "equity", "drawdown"))


@query("ewm_mean_std", "W21 W22 I2 scan", with_ctes("bars nb", ewm_sql("nb", {
    "e10": ("close", span(10)), "e20": ("close", span(20)), "e200": ("close", span(200)), "r20": ("lr", span(20))}) + f""",
 sq AS (SELECT symbol, rn, lr, lr AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2 FROM nb WHERE rn = 2
  UNION ALL SELECT n.symbol, n.rn, n.lr, (19.0::DOUBLE/21) * q.m + (2.0::DOUBLE/21) * n.lr,
   (19.0::DOUBLE/21) * (q.v + pow(q.m - ((19.0::DOUBLE/21) * q.m + (2.0::DOUBLE/21) * n.lr), 2))
    + (2.0::DOUBLE/21) * pow(n.lr - ((19.0::DOUBLE/21) * q.m + (2.0::DOUBLE/21) * n.lr), 2),
   q.s1 * (19.0::DOUBLE/21) + (2.0::DOUBLE/21), q.s2 * pow(19.0::DOUBLE/21, 2) + pow(2.0::DOUBLE/21, 2)
  FROM sq q JOIN nb n ON n.symbol = q.symbol AND n.rn = q.rn + 1)
 SELECT n.symbol, CAST(n.ts AS VARCHAR) AS ts, {qnum("CASE WHEN rn >= 10 THEN e10 END", "ema_10")},
 {qnum("CASE WHEN rn >= 20 THEN e20 END", "ema_20")}, {qnum("CASE WHEN rn >= 200 THEN e200 END", "ema_200")},
 {qnum("CASE WHEN rn >= 2 THEN r20 END", "ewm_return")},
 {qnum("CASE WHEN rn >= 11 THEN sqrt(v * s1 * s1 / (s1 * s1 - s2)) END", "ewm_vol", 9)}
 FROM nb n JOIN ew USING (symbol, rn) LEFT JOIN sq USING (symbol, rn)"""))
def ewm_mean_std(spark, d):
    df = windowed(b.bars(spark, d), lambda x, a: x.withColumn("lr", log_return("close", a)), lookback=1)
    ax = checked(df)
    df = ewm_mean(df, {"ema_10": ("close", span(10), 10), "ema_20": ("close", span(20), 20),
                       "ema_200": ("close", span(200), 200), "ewm_return": ("lr", span(20), 1)}, ax)
    df = ewm_std(df, "ewm_vol", "lr", span(20), 10, ax)
    return day_keys(df, *nums("ema_10", "ema_20", "ema_200", "ewm_return"), num("ewm_vol", 9).alias("ewm_vol"))


@query("session_running", "W11 I30 I31", with_ctes("intraday", f"""
 v AS (SELECT *, sum(close * volume) OVER s / sum(volume) OVER s AS vwap,
   sum((high + low + close) / 3 * volume) OVER s / sum(volume) OVER s AS tp_vwap FROM intraday
   WINDOW s AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 w AS (SELECT *, coalesce(stddev_samp(close - vwap) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS sd FROM v)
 {SEL}, {qnums("vwap", "tp_vwap")}, {qnum("vwap + sd", "vwap_upper_1")}, {qnum("vwap - sd", "vwap_lower_1")},
 {qnum("vwap + 3 * sd", "vwap_upper_3")}, {qnum("100 * (close - vwap) / vwap", "vwap_distance_pct")},
 {qnum("(high + low + close) / 3", "typical")} FROM w"""))
def session_running(spark, d):
    from tidemark.operators.sessions import anchored_vwap

    df = anchored_vwap(b.intraday(spark, d))
    df = anchored_vwap(
        df.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3), price="typical", prefix="tp_vwap"
    )
    return day_keys(df, *nums("vwap", "tp_vwap", "vwap_upper_1", "vwap_lower_1", "vwap_upper_3", "vwap_distance_pct", "typical"))


@query("rolling_any_lookahead", "W18 W19", with_ctes("bars", f"""
 {SEL}, {qnum(f"max(CASE WHEN volume > 40 THEN 1 ELSE 0 END) OVER {frame(10)}", "any_big_10")},
 {qnum(f"max(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)", "max_next_5")} FROM bars"""))
def rolling_any_lookahead(spark, d):
    df = windowed(
        b.bars(spark, d),
        lambda x, a: x.withColumns({
            "any_big_10": F.max((F.col("volume") > 40).cast("int")).over(a.trailing(10)),
            "max_next_5": F.max("high").over(a.rows(1, 5)),
        }),
        lookback=10, lookahead=5,
    )
    return day_keys(df, *nums("any_big_10", "max_next_5"))


@query("calendar_window", "W23", with_ctes("bars nb", f"""e AS (SELECT *, CAST(epoch(ts) AS BIGINT) AS t FROM nb)
 {SEL}, {qnum("CASE WHEN count(lr) OVER k >= 5 THEN stddev_samp(lr) OVER k END", "vol_30d")},
 count(*) OVER k AS rows_30d FROM e WINDOW k AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW)"""))
def calendar_window(spark, d):
    from tidemark.operators.sessions import trailing_days

    df = windowed(b.bars(spark, d), lambda x, a: x.withColumn("lr", log_return("close", a)), lookback=1)
    df = trailing_days(df, 30, "lr", least=5)
    return day_keys(df, num("vol_30d").alias("vol_30d"), "rows_30d")


@query("padded_sequence", "W23 T21", with_ctes("bars nb", f"""g AS (SELECT a.symbol, a.ts, list(x.close ORDER BY x.ts) AS seq
   FROM nb a JOIN nb x ON x.symbol = a.symbol AND x.ts BETWEEN a.ts - INTERVAL 30 DAY AND a.ts GROUP BY a.symbol, a.ts)
 {SEL}, len(seq) AS n_seq, {qnum("list_sum(list_resize(seq, greatest(len(seq), 12), seq[-1]))", "padded_sum")},
 {qnum("list_resize(seq, greatest(len(seq), 12), seq[-1])[12]", "item_12")} FROM g"""))
def padded_sequence(spark, d):
    from tidemark.operators.sessions import padded_days

    df = padded_days(b.bars(spark, d), 30, "close", 12)
    total = F.aggregate("seq", F.lit(0.0), lambda t, x: t + x)
    return day_keys(df, F.col("n_seq").cast("long").alias("n_seq"), num(total).alias("padded_sum"),
                    num(F.get("seq", F.lit(11))).alias("item_12"))


# --- indicators ------------------------------------------------------------------------------

GL = f"""gl AS (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
 greatest(high - low, abs(high - pc), abs(low - pc)) AS tr0,
 CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
 high - low AS hl, (high + low) / 2 AS mid,
 CASE WHEN (high - lag(high) OVER ({P})) > (lag(low) OVER ({P}) - low) AND high > lag(high) OVER ({P})
   THEN high - lag(high) OVER ({P}) ELSE 0 END AS pdm,
 CASE WHEN (lag(low) OVER ({P}) - low) > (high - lag(high) OVER ({P})) AND low < lag(low) OVER ({P})
   THEN lag(low) OVER ({P}) - low ELSE 0 END AS mdm FROM (SELECT * REPLACE (CASE WHEN rn = 1 THEN NULL ELSE pc END AS pc) FROM nb)),
 g0 AS (SELECT * REPLACE (CASE WHEN pc IS NULL THEN NULL ELSE gain END AS gain, CASE WHEN pc IS NULL THEN NULL ELSE loss END AS loss) FROM gl)"""


@query("rsi_wilder", "I7 I19", with_ctes("bars nb", GL + "," + ewm_sql("g0", {"ag": ("gain", wilder(14)), "al": ("loss", wilder(14))}) + f""",
 rs AS (SELECT n.symbol, n.ts, rn, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi0, CASE WHEN rn >= 15 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi
   FROM nb n JOIN ew USING (symbol, rn)),
 k AS (SELECT *, 100 * (rsi - {roll("min", "rsi", 14)}) / nullif(({roll("max", "rsi", 14)}) - ({roll("min", "rsi", 14)}), 0) AS raw FROM rs),
 k2 AS (SELECT *, {roll("avg", "raw", 3)} AS kk FROM k)
 {SEL}, {qnum("rsi", "rsi_14")}, {qnum("rsi0", "rsi_ungated")}, {qnum("kk", "stoch_rsi_k")},
 {qnum(roll("avg", "kk", 3), "stoch_rsi_d")} FROM k2"""))
def rsi_wilder(spark, d):
    bars = b.bars(spark, d)
    ax = checked(bars)
    df = ind.add_rsi(bars, ax, 14, "rsi_14")
    df = ind.add_rsi(df, ax, 14, "rsi_ungated", gated=False)
    df = ind.add_stochastic_rsi(df, ax)
    return day_keys(df, *nums("rsi_14", "rsi_ungated", "stoch_rsi_k", "stoch_rsi_d"))


@query("oscillators_window", "I8 I9 I18 I20 I22 I23 I25", with_ctes("bars nb", GL + f""",
 a AS (SELECT *, 100 * (close - ({roll("min", "low", 14)})) / nullif(({roll("max", "high", 14)}) - ({roll("min", "low", 14)}), 0) AS k,
  close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS trr,
  pow(100 * (close - ({roll("max", "close", 14)})) / ({roll("max", "close", 14)}), 2) AS dd2 FROM g0),
 a2 AS (SELECT *, {roll("avg", "k", 3)} AS ks FROM a)
 {SEL}, {qnum(f"100 - 100 / (1 + ({roll('avg', 'gain', 14)}) / (({roll('avg', 'loss', 14)}) + 1e-12))", "rsi_simple")},
 {qnum("k", "k_raw")}, {qnum(roll("avg", "k", 3), "d_raw")}, {qnum("ks", "stoch_k")}, {qnum(roll("avg", "ks", 3), "stoch_d")},
 {qnum(f"({roll('avg', 'mid', 5)}) - ({roll('avg', 'mid', 34)})", "awesome")},
 {qnum(f"-100 * (({roll('max', 'high', 14)}) - close) / nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0)", "williams_r")},
 {qnum("100 * (4 * (" + roll("sum", "bp", 7) + ") / nullif((" + roll("sum", "trr", 7) + "), 0) + 2 * (" + roll("sum", "bp", 14) + ") / nullif((" + roll("sum", "trr", 14) + "), 0) + (" + roll("sum", "bp", 28) + ") / nullif((" + roll("sum", "trr", 28) + "), 0)) / 7", "ultimate")},
 {qnum(f"(({roll('max', 'high', 26)}) + ({roll('min', 'low', 26)})) / 2", "ichimoku_base")},
 {qnum(f"sqrt({roll('avg', 'dd2', 14)})", "ulcer")} FROM a2"""))
def oscillators_window(spark, d):
    def add(x, a):
        x = ind.add_rsi_simple(x, a)
        x = ind.add_stochastic(x, a, 14, 1, 3).withColumnsRenamed({"stoch_k": "k_raw", "stoch_d": "d_raw"})
        x = ind.add_stochastic(x, a, 14, 3, 3)
        x = ind.add_ultimate(x, a)
        x = ind.add_ulcer(x, a)
        return x.withColumns({"awesome": ind.awesome(a), "williams_r": ind.williams_r(a), "ichimoku_base": ind.ichimoku_base(a)})

    df = windowed(b.bars(spark, d), add, lookback=60)
    return day_keys(df, *nums("rsi_simple", "k_raw", "d_raw", "stoch_k", "stoch_d", "awesome", "williams_r", "ultimate", "ichimoku_base", "ulcer"))


@query("bands_channels", "I14 I16", with_ctes("bars", f"""s AS (SELECT *, {roll("avg", "close", 20)} AS m, {roll("stddev_samp", "close", 20)} AS sd,
  {roll("stddev_pop", "close", 20)} AS sdp, {roll("max", "high", 20)} AS du, {roll("min", "low", 20)} AS dl FROM bars)
 {SEL}, {qnum("m", "bb_mid")}, {qnum("m + 2 * sd", "bb_upper")}, {qnum("m - 2 * sd", "bb_lower")}, {qnum("4 * sd / m", "bb_bandwidth")},
 {qnum("400 * sd / m", "bb_bandwidth_pct")}, {qnum("(close - (m - 2 * sd)) / nullif(4 * sd, 0)", "bb_percent_b")},
 {qnum("4 * sdp / m", "bb_bandwidth_pop")}, {qnum("du", "donchian_upper")}, {qnum("dl", "donchian_lower")},
 {qnum("(du + dl) / 2", "donchian_mid")}, {qnum("(du - dl) / ((du + dl) / 2)", "donchian_width")} FROM s"""))
def bands_channels(spark, d):
    def add(x, a):
        x = x.withColumns(ind.bollinger("close", a)).withColumns(ind.donchian(a))
        pop = ind.bollinger("close", a, population=True)["bb_bandwidth"]
        return x.withColumns({"bb_bandwidth_pct": 100 * F.col("bb_bandwidth"), "bb_bandwidth_pop": pop})

    df = windowed(b.bars(spark, d), add, lookback=20)
    return day_keys(df, *nums("bb_mid", "bb_upper", "bb_lower", "bb_bandwidth", "bb_bandwidth_pct", "bb_percent_b",
                              "bb_bandwidth_pop", "donchian_upper", "donchian_lower", "donchian_mid", "donchian_width"))


@query("atr_keltner_power", "I10 I15 I21 I24", with_ctes("bars nb", GL + "," + ewm_sql("g0", {
    "a14": ("tr", wilder(14)), "a10": ("tr", wilder(10)), "c20": ("close", span(20)), "c13": ("close", span(13)), "h10": ("hl", span(10))}) + f""",
 j AS (SELECT g0.*, a14, a10, c20, c13, h10, CASE WHEN rn >= 10 THEN h10 END AS h FROM g0 JOIN ew USING (symbol, rn))
 {SEL}, {qnum("tr", "tr")}, {qnum("CASE WHEN rn >= 14 THEN a14 END", "atr")}, {qnum("CASE WHEN rn >= 14 THEN 100 * a14 / close END", "natr")},
 {qnum(roll("avg", "tr", 14), "atr_simple")}, {qnum("CASE WHEN rn >= 20 THEN c20 END", "kc_center")},
 {qnum("CASE WHEN rn >= 20 THEN c20 + 2 * a10 END", "kc_upper")}, {qnum("CASE WHEN rn >= 20 THEN c20 - 2 * a10 END", "kc_lower")},
 {qnum("CASE WHEN rn >= 20 THEN 4 * a10 / c20 END", "kc_width")},
 {qnum("CASE WHEN rn >= 13 THEN high - c13 END", "bull_power")}, {qnum("CASE WHEN rn >= 13 THEN low - c13 END", "bear_power")},
 {qnum("CASE WHEN rn >= 13 THEN high + low - 2 * c13 END", "bull_bear_power")},
 {qnum(f"100 * (h / nullif(lag(h, 10) OVER ({P}), 0) - 1)", "chaikin_vol")} FROM j"""))
def atr_keltner_power(spark, d):
    bars = b.bars(spark, d)
    ax = checked(bars)
    df = with_parts(bars, ax, ind.atr_part(), ind.atr_simple_part(), ind.keltner_part(), ind.bull_bear_part(), ind.chaikin_part(), keep=["symbol", "ts", "high", "low", "close"])
    return day_keys(df, *nums("tr", "atr", "natr", "atr_simple", "kc_center", "kc_upper", "kc_lower", "kc_width",
                              "bull_power", "bear_power", "bull_bear_power", "chaikin_vol"))


@query("adx_both", "I11", with_ctes("bars nb", GL + "," + ewm_sql("g0", {"sp": ("pdm", wilder(14)), "sm": ("mdm", wilder(14)), "sr": ("tr", wilder(14))}) + f""",
 di AS (SELECT g0.*, CASE WHEN rn >= 14 THEN 100 * sp / nullif(sr, 0) END AS p, CASE WHEN rn >= 14 THEN 100 * sm / nullif(sr, 0) END AS m FROM g0 JOIN ew USING (symbol, rn)),
 dx AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM di), """ + ewm_sql("dx", {"adx": ("dx", wilder(14))}, "ew2") + f""",
 cn AS (SELECT symbol, rn, count(dx) OVER ({P} ROWS UNBOUNDED PRECEDING) AS seen FROM dx),
 sd AS (SELECT *, 100 * ({roll("sum", "pdm", 14)}) / (({roll("sum", "tr", 14)}) + 1e-12) AS ps, 100 * ({roll("sum", "mdm", 14)}) / (({roll("sum", "tr", 14)}) + 1e-12) AS ms FROM g0),
 sx AS (SELECT *, 100 * abs(ps - ms) / (ps + ms + 1e-12) AS dxs FROM sd),
 s3 AS (SELECT symbol, rn, ps, ms, {roll("avg", "dxs", 14)} AS adxs FROM sx)
 SELECT dx.symbol, CAST(dx.ts AS VARCHAR) AS ts, {qnum("p", "plus_di")}, {qnum("m", "minus_di")}, {qnum("CASE WHEN seen >= 14 THEN adx END", "adx")},
 {qnum("ps", "plus_di_simple")}, {qnum("ms", "minus_di_simple")}, {qnum("adxs", "adx_simple")}
 FROM dx JOIN ew2 USING (symbol, rn) JOIN cn USING (symbol, rn) JOIN s3 USING (symbol, rn)"""))
def adx_both(spark, d):
    bars = b.bars(spark, d)
    ax = checked(bars)
    df = ind.add_adx(bars, ax)
    df = windowed(df, lambda x, a: ind.add_adx_simple(x, a), ax, lookback=30)
    return day_keys(df, *nums("plus_di", "minus_di", "adx", "plus_di_simple", "minus_di_simple", "adx_simple"))


@query("macd_lines", "I12", with_ctes("bars nb", ewm_sql("nb", {"f": ("close", span(12)), "s": ("close", span(26))}) + f""",
 m AS (SELECT n.symbol, n.ts, n.rn, CASE WHEN n.rn >= 26 THEN f - s END AS macd FROM nb n JOIN ew USING (symbol, rn)), """ + ewm_sql("m", {"sig": ("macd", span(9))}, "ew2") + f"""
 {SEL}, {qnum("macd", "macd")}, {qnum("CASE WHEN rn >= 34 THEN sig END", "macd_signal")},
 {qnum("CASE WHEN rn >= 34 THEN macd - sig END", "macd_hist")} FROM m JOIN ew2 USING (symbol, rn)"""))
def macd_lines(spark, d):
    bars = b.bars(spark, d)
    return day_keys(ind.add_macd(bars, checked(bars)), *nums("macd", "macd_signal", "macd_hist"))


@query("fibonacci_levels", "I26", with_ctes("bars", f"""s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars),
 h AS (SELECT symbol, max(high) AS hi, min(low) AS lo FROM s WHERE back <= 100 GROUP BY symbol)
 SELECT symbol, level, kind, {qnum("CASE WHEN kind = 'retracement' THEN hi - CAST(level AS DOUBLE) * (hi - lo) ELSE hi + (CAST(level AS DOUBLE) - 1) * (hi - lo) END", "price")}
 FROM h, (SELECT unnest(['0.0', '0.236', '0.382', '0.5', '0.618', '0.786', '1.0']) AS level, 'retracement' AS kind
   UNION ALL SELECT unnest(['1.272', '1.414', '1.618', '2.0', '2.618', '3.618']), 'extension')"""))
def fibonacci_levels(spark, d):
    from tidemark.operators.tables import last_rows

    tail = last_rows(b.bars(spark, d).select("symbol", "ts", "high", "low"), BARS, 100)
    swing = tail.groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    levels = ind.fibonacci(F.col("hi"), F.col("lo"))
    parts = [
        swing.select("symbol", F.lit(kind).alias("kind"), F.explode(m).alias("level", "price")) for kind, m in levels.items()
    ]
    return parts[0].unionByName(parts[1]).select("symbol", "level", "kind", num("price").alias("price"))


def label_sql(value: str, buy: float, sell: float, reverse: bool = False) -> str:
    first, second = (f"{value} <= {sell} THEN 'Buy'", f"{value} >= {buy} THEN 'Sell'") if reverse else (f"{value} >= {buy} THEN 'Buy'", f"{value} <= {sell} THEN 'Sell'")
    return f"CASE WHEN {value} IS NULL THEN 'Neutral' WHEN {first} WHEN {second} ELSE 'Neutral' END"


def above_sql(level: str) -> str:
    return f"CASE WHEN close > {level} THEN 'Buy' ELSE 'Sell' END"


W14 = wilder(14)
CORE_EWM = {
    **{f"e{n}": ("close", span(n)) for n in ind.AVERAGES}, "ag": ("gain", W14), "al": ("loss", W14), "a14": ("tr", W14), "sp": ("pdm", W14), "sm": ("mdm", W14),
    "c12": ("close", span(12)), "c26": ("close", span(26)), "c13": ("close", span(13)), "h10": ("hl", span(10)),
}
CORE_LABELS = {
    "action_rsi_14": label_sql("rsi_14", 70, 30, True), "action_stoch_k": label_sql("stoch_k", 80, 20, True), "action_cci_20": label_sql("cci_20", 100, -100, True),
    "action_adx_14": label_sql("adx_14", 25, 20), "action_macd": label_sql("macd_12_26", 0, 0), "action_momentum_10": label_sql("momentum_10", 0, 0),
    "action_stoch_rsi_k": label_sql("stoch_rsi_fast_k", 80, 20, True), "action_williams_r_14": label_sql("williams_r_14", -20, -80, True),
    "action_bull_bear_power": label_sql("bull_bear_power", 0, 0), "action_ultimate_osc": label_sql("ultimate_osc_7_14_28", 70, 30, True),
    **{f"action_{k}_{n}": above_sql(f"{k}_{n}") for n in ind.AVERAGES for k in ("ema", "sma")},
    "action_ichimoku_base_26": above_sql("ichimoku_base_26"), "action_vwma_20": above_sql("vwma_20"), "action_hma_9": above_sql("hma_9"),
}
YZ = 0.34 / (1.34 + 21 / 19)
CORE_SQL = f"""{GL}, {ewm_sql("g0", CORE_EWM)},
 j AS (SELECT g0.*, {", ".join(f"CASE WHEN rn >= {n} THEN e{n} END AS ema_{n}, {roll('avg', 'close', n)} AS sma_{n}" for n in ind.AVERAGES)},
  CASE WHEN rn >= 15 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi_14, CASE WHEN rn >= 14 THEN a14 END AS atr_14, CASE WHEN rn >= 26 THEN c12 - c26 END AS macd_12_26,
  CASE WHEN rn >= 13 THEN high + low - 2 * c13 END AS bull_bear_power, CASE WHEN rn >= 10 THEN h10 END AS h, CASE WHEN rn >= 14 THEN 100 * abs(sp - sm) / nullif(CASE WHEN a14 <> 0 THEN sp + sm END, 0) END AS dx,
  100 * (close - ({roll("min", "low", 14)})) / nullif(({roll("max", "high", 14)}) - ({roll("min", "low", 14)}), 0) AS k, close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS trr,
  pow(100 * (close - ({roll("max", "close", 14)})) / ({roll("max", "close", 14)}), 2) AS dd2, (high + low + close) / 3 AS t, avg((high + low + close) / 3) OVER {frame(20)} AS ma,
  2 * ({wma_sql("close", 4)}) - ({wma_sql("close", 9)}) AS hraw, ln(high / low) AS hlr, ln(close / open) AS co, ln(high / open) AS ho, ln(low / open) AS lo, ln(high / close) AS hc, ln(low / close) AS lc, ln(open / pc) AS ovn
  FROM g0 JOIN ew USING (symbol, rn)),
 {ewm_sql("j", {"adx": ("dx", W14)}, "ew2")},
 dev AS (SELECT a.symbol, a.rn, avg(abs(x.t - a.ma)) AS mad FROM j a JOIN j x ON x.symbol = a.symbol AND x.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20 GROUP BY ALL),
 j2 AS (SELECT j.*, adx, mad, hlr * hlr AS hl2, 0.5 * hlr * hlr - (2 * ln(2) - 1) * co * co AS gk, ho * hc + lo * lc AS rs,
  100 * (rsi_14 - ({roll("min", "rsi_14", 14)})) / nullif(({roll("max", "rsi_14", 14)}) - ({roll("min", "rsi_14", 14)}), 0) AS raw FROM j JOIN ew2 USING (symbol, rn) LEFT JOIN dev USING (symbol, rn)),
 z AS (SELECT *, {roll("avg", "k", 3)} AS stoch_k, (t - ma) / (0.015 * nullif(mad, 0)) AS cci_20, CASE WHEN count(dx) OVER ({P} ROWS UNBOUNDED PRECEDING) >= 14 THEN adx END AS adx_14,
  ({roll("avg", "mid", 5)}) - ({roll("avg", "mid", 34)}) AS awesome_oscillator, close - lag(close, 10) OVER ({P}) AS momentum_10, {roll("avg", "raw", 3)} AS stoch_rsi_fast_k,
  -100 * (({roll("max", "high", 14)}) - close) / nullif(({roll("max", "high", 14)}) - ({roll("min", "low", 14)}), 0) AS williams_r_14,
  100 * (4 * ({roll("sum", "bp", 7)}) / nullif(({roll("sum", "trr", 7)}), 0) + 2 * ({roll("sum", "bp", 14)}) / nullif(({roll("sum", "trr", 14)}), 0) + ({roll("sum", "bp", 28)}) / nullif(({roll("sum", "trr", 28)}), 0)) / 7 AS ultimate_osc_7_14_28,
  (({roll("max", "high", 26)}) + ({roll("min", "low", 26)})) / 2 AS ichimoku_base_26, ({roll("sum", "close * volume", 20)}) / ({roll("sum", "volume", 20)}) AS vwma_20, {wma_sql("hraw", 3)} AS hma_9, 100 * atr_14 / close AS natr_14,
  ({roll("stddev_samp", "lr", 20)}) * sqrt(252) AS rolling_vol_20, sqrt(252 * ({roll("avg", "hl2", 20)}) / (4 * ln(2))) AS parkinson_vol_20,
  CASE WHEN ({roll("avg", "gk", 20)}) >= 0 THEN sqrt(252 * ({roll("avg", "gk", 20)})) END AS garman_klass_vol_20, sqrt(252 * ({roll("avg", "rs", 20)})) AS rogers_satchell_vol_20,
  sqrt(252 * (({roll("var_samp", "ovn", 20)}) + {YZ!r}::DOUBLE * ({roll("var_samp", "co", 20)}) + {1 - YZ!r}::DOUBLE * ({roll("avg", "rs", 20)}))) AS yang_zhang_vol_20,
  100 * (h / nullif(lag(h, 10) OVER ({P}), 0) - 1) AS chaikin_vol_10_10, sqrt({roll("avg", "dd2", 14)}) AS ulcer_index_14 FROM j2)"""


@query("core_indicator_summary", "I27 I28", with_ctes("bars nb", CORE_SQL + f""" {SEL}, close, {qnums(*ind.CORE_COLUMNS)}, {", ".join(f"{c} AS {n}" for n, c in CORE_LABELS.items())} FROM z"""))
def core_indicator_summary(spark, d):
    bars = b.bars(spark, d)
    df = ind.core_summary(bars, checked(bars))
    return df.withColumn("ts", F.col("ts").cast("string")).withColumns({c: num(c) for c in ind.CORE_COLUMNS})


BLOCK_EWM = {"e20": ("close", span(20)), "ag": ("gain", W14), "al": ("loss", W14), "a14": ("tr", W14), "sp": ("pdm", W14), "sm": ("mdm", W14), "c12": ("close", span(12)), "c26": ("close", span(26))}
BLOCK_SQL = f"""{GL}, {ewm_sql("g0", BLOCK_EWM)},
 j AS (SELECT g0.*, CASE WHEN rn >= 20 THEN e20 END AS ema_20, CASE WHEN rn >= 15 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi_14, CASE WHEN rn >= 14 THEN a14 END AS atr_14,
  CASE WHEN rn >= 14 AND a14 > 0 THEN 100 * sp / a14 END AS plus_di, CASE WHEN rn >= 14 AND a14 > 0 THEN 100 * sm / a14 END AS minus_di, CASE WHEN rn >= 26 THEN c12 - c26 END AS macd,
  ln(high / low) AS hlr, ln(close / open) AS co FROM g0 JOIN ew USING (symbol, rn)),
 j2 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx, hlr * hlr AS hl2, 0.5 * hlr * hlr - (2 * ln(2) - 1) * co * co AS gk FROM j),
 {ewm_sql("j2", {"adx": ("dx", W14), "sig": ("macd", span(9))}, "ew2")},
 z AS (SELECT j2.*, CASE WHEN count(dx) OVER ({P} ROWS UNBOUNDED PRECEDING) >= 14 THEN adx END AS adx_14, CASE WHEN rn >= 34 THEN sig END AS macd_signal, CASE WHEN rn >= 34 THEN macd - sig END AS macd_hist,
  {", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200))}, close - lag(close, 10) OVER ({P}) AS mom_10, 100 * (close / nullif(lag(close, 10) OVER ({P}), 0) - 1) AS roc_10,
  400 * ({roll("stddev_samp", "close", 20)}) / ({roll("avg", "close", 20)}) AS bb_bandwidth, ({roll("stddev_samp", "ret", 20)}) * sqrt(252) AS vol_20, sqrt(252 * ({roll("avg", "hl2", 20)}) / (4 * ln(2))) AS parkinson_vol,
  CASE WHEN ({roll("avg", "gk", 20)}) >= 0 THEN sqrt(252 * ({roll("avg", "gk", 20)})) END AS gk_vol FROM j2 JOIN ew2 USING (symbol, rn))"""


@query("default_feature_block", "I29", with_ctes("bars nb", BLOCK_SQL + f""" {SEL}, {qnums(*ind.DEFAULT_FEATURES)} FROM z"""))
def default_feature_block(spark, d):
    bars = b.bars(spark, d)
    df = ind.default_features(bars, checked(bars))
    return df.withColumn("ts", F.col("ts").cast("string")).withColumns({c: num(c) for c in ind.DEFAULT_FEATURES})


@query("action_labels", "I27", with_ctes("bars nb", f"""k AS (SELECT *, 100 * (close - ({roll("min", "low", 14)})) / nullif(({roll("max", "high", 14)}) - ({roll("min", "low", 14)}), 0) AS k,
   close - lag(close, 10) OVER ({P}) AS mom FROM nb)
 {SEL}, CASE WHEN k IS NULL THEN 'Neutral' WHEN k <= 20 THEN 'Buy' WHEN k >= 80 THEN 'Sell' ELSE 'Neutral' END AS reversed_label,
 CASE WHEN k IS NULL THEN 'Neutral' WHEN k <= 80 THEN 'Buy' WHEN k >= 20 THEN 'Sell' ELSE 'Neutral' END AS literal_label,
 CASE WHEN mom IS NULL THEN 'Neutral' WHEN mom >= 0 THEN 'Buy' WHEN mom <= 0 THEN 'Sell' ELSE 'Neutral' END AS momentum_label FROM k"""))
def action_labels(spark, d):
    df = windowed(
        b.bars(spark, d),
        lambda x, a: x.withColumns({"k": ind.stochastic_k(a, 14), "mom": ind.momentum("close", a, 10)}),
        lookback=14,
    )
    return day_keys(
        df, ind.action("k", 80, 20, True).alias("reversed_label"), ind.action("k", 80, 20, True, compat=True).alias("literal_label"),
        ind.action("mom", 0, 0).alias("momentum_label"),
    )


@query("volume_delta_proxy", "I33 W11", with_ctes("intraday", f"""
 t AS (SELECT *, CASE WHEN close > lag(close) OVER ({P}) THEN volume WHEN close < lag(close) OVER ({P}) THEN -volume ELSE 0 END AS dv,
   sum(close * volume) OVER s / sum(volume) OVER s AS vwap FROM intraday WINDOW s AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT *, sum(dv) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cd FROM t),
 z AS (SELECT *, coalesce((cd - avg(cd) OVER {frame(50)}) / (CASE WHEN stddev_samp(cd) OVER {frame(50)} = 0 THEN 1 ELSE stddev_samp(cd) OVER {frame(50)} END), 0) AS z FROM c)
 {SEL}, {qnum("cd", "cumulative_delta")}, {qnum("z", "cd_zscore")}, z > 1.5 AND close > vwap AS dh_green_bar,
 z < -1.5 AND close < vwap AS dh_red_bar, {qnum("least(abs(z), 5) * 2", "dh_intensity")} FROM z"""))
def volume_delta_proxy(spark, d):
    from tidemark.operators.sessions import anchored_vwap, volume_delta

    df = volume_delta(anchored_vwap(b.intraday(spark, d)), look=10)
    return day_keys(df, *nums("cumulative_delta", "cd_zscore"), "dh_green_bar", "dh_red_bar", *nums("dh_intensity"))


@query("sensitivity_proxies", "I32", with_ctes("intraday", f"""
 q AS (SELECT *, row_number() OVER ({P}) AS rn, coalesce(close / lag(close, 10) OVER ({P}) - 1, 0) AS dp,
   coalesce(close / lag(close) OVER ({P}) - 1, 0) AS ret FROM intraday), """ + ewm_sql("q", {"ds": ("dp", span(10))}) + f""",
 n AS (SELECT q.*, ds, max(abs(ds)) OVER {frame(20)} AS dmax FROM q JOIN ew USING (symbol, rn)),
 n2 AS (SELECT *, coalesce(greatest(-1, least(1, ds / (CASE WHEN dmax = 0 THEN 0.001 ELSE dmax END))), 0) AS dn,
   coalesce(ds - lag(ds) OVER ({P}), 0) AS graw, {roll("stddev_samp", "ret", 20, 5)} AS vol FROM n),
 n3 AS (SELECT *, CASE WHEN stddev_samp(graw) OVER {frame(20)} IS NULL THEN 0 ELSE greatest(-3, least(3, graw / (CASE WHEN stddev_samp(graw) OVER {frame(20)} = 0 THEN 0.0001 ELSE stddev_samp(graw) OVER {frame(20)} END))) END AS gn FROM n2)
 {SEL}, {qnum("dp", "delta_proxy")}, {qnum("ds", "delta_smooth")}, {qnum("dn", "delta_norm")}, {qnum("graw", "gamma_raw")}, {qnum("gn", "gamma_norm")},
 {qnum(f"avg(abs(gn)) OVER {frame(10)}", "gamma_magnitude")}, {qnum(f"coalesce(dn * (vol - lag(vol) OVER ({P})), 0)", "vanna_proxy")} FROM n3"""))
def sensitivity_proxies(spark, d):
    from tidemark.operators.sessions import sensitivity_proxies as proxies

    df = proxies(b.intraday(spark, d))
    return day_keys(df, *nums("delta_proxy", "delta_smooth", "delta_norm", "gamma_raw", "gamma_norm", "gamma_magnitude", "vanna_proxy"))


@query("bar_state_features", "I34", with_ctes("bars nb", f"""
 f AS (SELECT *, coalesce({roll("avg", "ret", 20)}, 0) AS m, coalesce({roll("stddev_samp", "ret", 20)}, 0) AS sd,
   {roll("avg", "close", 20)} AS cm, {roll("stddev_samp", "close", 20)} AS cs FROM nb),
 f2 AS (SELECT *, least(greatest(sd, 0), 0.05) AS vol, abs(ret - m) AS dv FROM f),
 f3 AS (SELECT *, coalesce({roll("avg", "dv", 3)}, 0) AS kl FROM f2)
 {SEL}, {qnum("m", "signal")}, {qnum("vol", "vol")}, {qnum("kl", "kl")}, {qnum("tanh(m * 10)", "signal_norm")},
 {qnum("vol / (max(vol) OVER (PARTITION BY symbol) + 1e-6)", "vol_norm")}, {qnum("tanh(kl * 20)", "kl_norm")},
 {qnum("coalesce(tanh((close - cm) / (cs + 1e-6)), 0)", "price_trend")} FROM f3"""))
def bar_state_features(spark, d):
    from tidemark.operators.sessions import state_features

    df = state_features(b.bars(spark, d), 20)
    return day_keys(df, *nums("signal", "vol", "kl", "signal_norm", "vol_norm", "kl_norm", "price_trend"))


@query("lagged_return_features", "I35", with_ctes("bars nb", f"""h AS (SELECT *, lag(ret) OVER ({P}) AS h FROM nb)
 {SEL}, {qnum("h", "ret_lag")}, {qnum(roll("avg", "h", 5, 2), "mean_5")}, {qnum(roll("stddev_samp", "h", 5, 2), "std_5")},
 {qnum(roll("avg", "h", 20, 5), "mean_20")}, {qnum(roll("stddev_samp", "h", 20, 5), "std_20")}, {qnum(roll("avg", "abs(h)", 20, 5), "abs_20")} FROM h"""))
def lagged_return_features(spark, d):
    from tidemark.operators.sessions import lagged_returns

    df = windowed(b.bars(spark, d), lagged_returns, lookback=24)
    return day_keys(df, *nums("ret_lag", "mean_5", "std_5", "mean_20", "std_20", "abs_20"))


@query("market_breadth", "I36", with_ctes("bars nb", """d AS (SELECT ts, avg(ret) AS mean_ret, avg(abs(ret)) AS abs_ret,
   avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth, avg(volume) AS i_mean, stddev_samp(volume) AS i_std FROM nb GROUP BY ts),
 o AS (SELECT *, 1 AS one FROM d)
 SELECT CAST(ts AS VARCHAR) AS ts, """ + qnums("mean_ret", "abs_ret", "breadth", "i_mean", "i_std") + ", "
 + ", ".join(qnum(f"CASE WHEN count({x}) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {m} THEN {f}({x}) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END", o)
             for o, f, x, n, m in (("i_mom5", "avg", "i_mean", 5, 3), ("ret_mom5", "avg", "mean_ret", 5, 3), ("ret_mom10", "avg", "mean_ret", 10, 5), ("vol20", "stddev_samp", "mean_ret", 20, 10)))
 + " FROM o"))
def market_breadth(spark, d):
    from tidemark.operators.crosssection import breadth

    df = windowed(b.bars(spark, d), lambda x, a: x.withColumn("ret", pct_change("close", a)), lookback=1)
    out = breadth(df, "ret", "volume")
    return out.select(text("ts"), *nums("mean_ret", "abs_ret", "breadth", "i_mean", "i_std", "i_mom5", "ret_mom5", "ret_mom10", "vol20"))


# --- volatility ------------------------------------------------------------------------------

LN = f"""q AS (SELECT *, CASE WHEN lower(asset_group) = 'asia' THEN 365.0::DOUBLE ELSE 252.0::DOUBLE END AS py, ln(high / low) AS hl, ln(close / open) AS co, ln(high / open) AS ho, ln(low / open) AS lo,
 ln(high / close) AS hc, ln(low / close) AS lc, ln(open / pc) AS ovn FROM nb),
 q2 AS (SELECT *, hl * hl AS hl2, 0.5 * hl * hl - (2 * ln(2) - 1) * co * co AS gk, ho * hc + lo * lc AS rs FROM q)"""
def per_year():
    return vol.periods_per_year(always_open=("asia",))


@query("range_volatility", "V1 V3 V4 V5 V6", with_ctes("bars nb", LN + f""" {SEL},
 {qnum(f"({roll('stddev_samp', 'lr', 20)}) * sqrt(252)", "close_vol")}, {qnum(f"({roll('stddev_samp', 'ret', 20)}) * sqrt(252)", "simple_vol")},
 {qnum(f"sqrt(252 * ({roll('avg', 'hl2', 20)}) / (4 * ln(2)))", "parkinson")}, {qnum(f"CASE WHEN ({roll('avg', 'gk', 20)}) >= 0 THEN sqrt(252 * ({roll('avg', 'gk', 20)})) END", "garman_klass")},
 {qnum(f"sqrt(252 * ({roll('avg', 'rs', 20)}))", "rogers_satchell")},
 {qnum(f"sqrt(252 * (({roll('var_samp', 'ovn', 20)}) + {0.34 / (1.34 + 21 / 19)!r}::DOUBLE * ({roll('var_samp', 'co', 20)}) + {1 - 0.34 / (1.34 + 21 / 19)!r}::DOUBLE * ({roll('avg', 'rs', 20)})))", "yang_zhang")} FROM q2"""))
def range_volatility(spark, d):
    def add(x, a):
        x = x.withColumns({**vol.base_returns(a)})
        rs = ind.rogers_satchell_term()
        return x.withColumns({
            "close_vol": ind.close_vol("log_return", a, 20, 252), "simple_vol": ind.close_vol("simple_return", a, 20, 252),
            "parkinson": ind.range_vol(ind.parkinson_term(), a, 20, 252),
            "garman_klass": ind.range_vol(ind.garman_klass_term(), a, 20, 252),
            "rogers_satchell": ind.range_vol(rs, a, 20, 252),
            "yang_zhang": F.sqrt(252 * ind.yang_zhang_variance(a, 20, rs, "overnight_return")),
        })

    df = windowed(b.bars(spark, d), add, lookback=22)
    return day_keys(df, *nums("close_vol", "simple_vol", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang"))


@query("historical_volatility", "V2", with_ctes("bars nb", f"""SELECT symbol, {qnum("stddev_samp(lr) * sqrt(252)", "hist_vol_log")},
 {qnum("stddev_samp(ret) * sqrt(252)", "hist_vol_simple")} FROM nb GROUP BY symbol"""))
def historical_volatility(spark, d):
    df = windowed(b.bars(spark, d), lambda x, a: x.withColumns({"lr": log_return("close", a), "ret": pct_change("close", a)}), lookback=1)
    return df.groupBy("symbol").agg(num(F.stddev_samp("lr") * F.sqrt(F.lit(252.0))).alias("hist_vol_log"),
                                    num(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("hist_vol_simple"))


def block_sql(n: int) -> str:
    m = max(5, n // 2)
    k = 0.34 / (1.34 + (n + 1) / max(n - 1, 1))
    return ", ".join([
        qnum(f"({roll('stddev_samp', 'lr', n, m)}) * sqrt(py)", f"rv_close_{n}"),
        qnum(f"sqrt(py * ({roll('avg', 'hl2', n, m)}) / (4 * ln(2)))", f"rv_parkinson_{n}"),
        qnum(f"sqrt(py * ({roll('avg', 'greatest(gk, 0)', n, m)}))", f"rv_garman_klass_{n}"),
        qnum(f"sqrt(py * ({roll('avg', 'greatest(rs, 0)', n, m)}))", f"rv_rogers_satchell_{n}"),
        qnum(f"CASE WHEN ({roll('var_samp', 'ovn', n, m)}) IS NOT NULL THEN 1 END * sqrt(py * greatest(({roll('var_samp', 'ovn', n, m)}) + {k!r}::DOUBLE * ({roll('var_samp', 'co', n, m)}) + {1 - k!r}::DOUBLE * ({roll('avg', 'greatest(rs, 0)', n, m)}), 0))", f"rv_yang_zhang_{n}"),
    ])


@query("volatility_block", "V7 V8 V9 V10 V11 R1", with_ctes("bars nb", LN + f""",
 e AS (SELECT *, (lr - ({roll("avg", "lr", 60, 30)})) / nullif(({roll("stddev_samp", "lr", 60, 30)}), 0) AS z,
  {roll("quantile_cont({x}, 0.9)", "abs(lr)", 60, 30)} AS q9 FROM q2)
 {SEL}, {qnum("ovn", "overnight_return")}, {qnum("co", "intraday_return")}, {qnum("hl", "hl_log_range")}, {qnum("ho", "ho_log_range")}, {qnum("lo", "lo_log_range")},
 {qnum("abs(lr)", "abs_return")}, {qnum("lr * lr", "squared_return", 9)}, {block_sql(10)}, {block_sql(20)}, {block_sql(60)},
 {qnum("close / (" + roll("max", "close", 60, 2) + ") - 1", "drawdown_60")},
 {qnum("(volume - (" + roll("avg", "volume", 20, 10) + ")) / (" + roll("stddev_samp", "volume", 20, 10) + ")", "volume_z_20")},
 {qnum("z", "return_z_60")}, coalesce(abs(z) >= 2.25, false) AS jump_event, coalesce(abs(lr) >= q9, false) AS high_vol_event,
 CASE WHEN coalesce(abs(z) >= 2.25, false) OR coalesce(abs(lr) >= q9, false) THEN 1 ELSE 0 END AS event_flag FROM e"""))
def volatility_block(spark, d):
    def add(x, a):
        x = x.withColumns(vol.base_returns(a))
        return vol.add_events(with_frames(x, a, vol.drawdown_from_peak(), vol.volume_z(), *[vol.vol_block(n, per_year()) for n in (10, 20, 60)], vol.event_levels()))

    df = windowed(b.bars(spark, d), add, lookback=62)
    cols = [f"rv_{k}_{n}" for n in (10, 20, 60) for k in ("close", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")]
    return day_keys(df, *nums("overnight_return", "intraday_return", "hl_log_range", "ho_log_range", "lo_log_range", "abs_return", *cols,
                              "drawdown_60", "volume_z_20", "return_z_60"), num("squared_return", 9).alias("squared_return"),
                    "jump_event", "high_vol_event", "event_flag")


@query("volatility_surface", "V12", with_ctes("bars nb", f"""k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_rows, """
 + ", ".join(f"({roll('stddev_samp', 'lr', n)}) * sqrt(252) AS w{n}" for n in (5, 10, 20, 30, 60, 90)) + f""" FROM nb),
 k2 AS (SELECT * FROM k WHERE rn - 1 >= 90 AND rn - 1 >= n_rows - 252)
 """ + " UNION ALL ".join(f"{SEL}, {n} AS window_len, {qnum(f'w{n}', 'vol')} FROM k2" for n in (5, 10, 20, 30, 60, 90))))
def volatility_surface(spark, d):
    from tidemark.operators.series import positions
    from tidemark.operators.tables import with_group_size

    bars = b.bars(spark, d).select("symbol", "ts", "close")
    df = with_group_size(positions(bars), ["symbol"], "n_rows")
    out = vol.realised_surface(df, BARS, (5, 10, 20, 30, 60, 90), 252)
    return out.select("symbol", text("ts"), F.col("window").alias("window_len"), num("vol").alias("vol"))


@query("combined_volatility", "V13", with_ctes("bars nb", LN + f""" {SEL},
 {qnum(f"(({roll('stddev_samp', 'lr', 20)}) * sqrt(252) + sqrt(252 * ({roll('avg', 'hl2', 20)}) / (4 * ln(2))) + sqrt(252 * ({roll('avg', 'greatest(gk, 0)', 20)}))) / 3", "combined_vol")} FROM q2"""))
def combined_volatility(spark, d):
    from tidemark.functions.cleaning import clip

    def add(x, a):
        x = x.withColumn("lr", log_return("close", a))
        gk = clip(ind.garman_klass_term(), low=0.0)
        parts = ind.close_vol("lr", a, 20, 252) + ind.range_vol(ind.parkinson_term(), a, 20, 252) + ind.range_vol(gk, a, 20, 252)
        return x.withColumn("combined_vol", parts / 3)

    return day_keys(windowed(b.bars(spark, d), add, lookback=22), *nums("combined_vol"))
