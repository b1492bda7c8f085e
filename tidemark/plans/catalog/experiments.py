"""Grids, folds, simulations, stress windows, comparisons; micro-structure patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cleaning import ratio
from tidemark.operators import crosssection as xs
from tidemark.operators import experiments as ex
from tidemark.operators import metrics as mx
from tidemark.operators import microstructure as ms
from tidemark.operators import portfolio as pf
from tidemark.operators import signals as sg
from tidemark.operators.backtest import target_backtest
from tidemark.operators.series import BARS, Axis, checked, following, pct_change, positions, prev, roll_mean, windowed
from tidemark.operators.sessions import anchored_vwap, sensitivity_proxies, volume_delta
from tidemark.operators.tables import with_group_size
from tidemark.plans.catalog.portfolio import FAMILY, IBANDS, market, returns
from tidemark.operators.recurrences import span
from tidemark.plans.catalog.windows import P, SEL, frame, roll
from tidemark.plans.registry import ewm_sql, num, nums, qnum, qnums, query, text, with_ctes
from tidemark.sources import bindings as b

POINTS = ex.grid(fast=[5, 10], slow=[20, 40])


def grid_sql(src: str, keys: str) -> str:
    """SMA-cross curves per (keys, fast, slow) from ``src``; weights are 0 or 1, so nothing drifts."""
    k = f"PARTITION BY {keys} ORDER BY ts"
    means = ", ".join(f"CASE WHEN count(*) OVER ({k} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg(close) OVER ({k} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS m{n}" for n in (5, 10, 20, 40))
    kk = f"PARTITION BY {keys}, fast, slow ORDER BY ts"
    return f"""gm AS (SELECT *, {means} FROM {src}),
 gs AS (SELECT gm.*, f.fast, s.slow, CASE WHEN coalesce(CASE f.fast WHEN 5 THEN m5 ELSE m10 END > CASE s.slow WHEN 20 THEN m20 ELSE m40 END, false) THEN 1.0::DOUBLE ELSE 0 END AS w
   FROM gm, (SELECT unnest([5, 10]) AS fast) f, (SELECT unnest([20, 40]) AS slow) s),
 gt AS (SELECT *, abs(w - coalesce(lag(w) OVER ({kk}), 0)) AS tau, lag(w) OVER ({kk}) AS w0, lag(close) OVER ({kk}) AS p0 FROM gs),
 ge AS (SELECT *, exp(sum(ln(coalesce(1 - 0.0005::DOUBLE * ltau + w0 * (close / p0 - 1), 1))) OVER ({kk} ROWS UNBOUNDED PRECEDING)) * (1 - 0.0005::DOUBLE * tau) AS eq FROM (SELECT *, lag(tau) OVER ({kk}) AS ltau FROM gt)),
 gr AS (SELECT *, coalesce(eq / lag(eq) OVER ({kk}) - 1, 0) AS r, eq / max(eq) OVER ({kk} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ge),
 sc AS (SELECT {keys}, fast, slow, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) END AS sharpe,
   CASE WHEN count(*) < 2 THEN 0 ELSE (arg_max(eq, ts) / arg_min(eq, ts) - 1) * 100 END AS tr, CASE WHEN count(*) < 2 THEN 0 ELSE min(dd) * 100 END AS dd FROM gr GROUP BY {keys}, fast, slow)"""


@query("grid_search", "X1 J14", with_ctes("bars", grid_sql("bars", "symbol") + f"""SELECT symbol, fast, slow, {qnum("sharpe", "sharpe")}, {qnum("tr", "total_return_pct")} FROM sc"""))
def grid_search(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    ax = checked(bars)
    s = ex.score_curves(ex.sma_grid_curves(bars, POINTS, ax), ax)
    return s.select("symbol", "fast", "slow", *nums("sharpe", "total_return_pct"))


@query("grid_best_heatmap", "X1 A14", with_ctes("bars", grid_sql("bars", "symbol") + f"""SELECT symbol, {", ".join(qnum(f"max(CASE WHEN fast = {f} AND slow = {s} THEN sharpe END)", f"f{f}_s{s}") for f in (5, 10) for s in (20, 40))},
 arg_max(fast, round(sharpe, 9) * 1e6 - fast * 1e-7) AS best_fast FROM sc GROUP BY symbol"""))
def grid_best_heatmap(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    ax = checked(bars)
    s = ex.score_curves(ex.sma_grid_curves(bars, POINTS, ax), ax)
    cells = [F.max(F.when((F.col("fast") == f) & (F.col("slow") == sl), F.col("sharpe"))) for f in (5, 10) for sl in (20, 40)]
    names = [f"f{f}_s{sl}" for f in (5, 10) for sl in (20, 40)]
    # heat map and best point in one grouping of the score table
    pick = F.max_by("fast", F.struct("score", -F.col("fast"), -F.col("slow")))
    return s.groupBy("symbol").agg(*[num(c).alias(n) for c, n in zip(cells, names)], pick.alias("best_fast"))


FOLDS3 = """ps AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 sl AS (SELECT symbol, ts, close, f AS fold, 'train' AS role FROM ps, (SELECT unnest(range(1, 6)) AS f) WHERE p < f * (n // 6) UNION ALL
  SELECT symbol, ts, close, f, 'test' FROM ps, (SELECT unnest(range(1, 6)) AS f) WHERE p >= f * (n // 6) AND p < least((f + 1) * (n // 6), n)),
 ok AS (SELECT symbol, fold FROM sl GROUP BY symbol, fold HAVING count(*) FILTER (role = 'train') >= 100 AND count(*) FILTER (role = 'test') >= 20),
 sv AS (SELECT sl.* FROM sl JOIN ok USING (symbol, fold)), """
BEST = """, bs AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 9) DESC, fast, slow) AS k FROM sc WHERE role = 'train')
 SELECT b.symbol, b.fold, b.fast, b.slow, """ + qnum("b.sharpe", "train_sharpe") + ", " + qnum("t.sharpe", "test_sharpe") + ", " + qnum("t.tr", "test_return_pct") + ", " + qnum("t.dd", "test_max_dd_pct") \
 + " FROM bs b JOIN sc t ON t.symbol = b.symbol AND t.fold = b.fold AND t.fast = b.fast AND t.slow = b.slow AND t.role = 'test' WHERE k = 1"


def fold_rows(df):
    return df.select("symbol", "fold", "fast", "slow", *nums("train_sharpe", "test_sharpe", "test_return_pct", "test_max_dd_pct"))


@query("time_split_test", "X3", with_ctes("bars", FOLDS3 + grid_sql("sv", "symbol, fold, role") + BEST))
def time_split_test(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    return fold_rows(ex.optimise_folds(ex.expanding_folds(bars, 5), POINTS))


def walk_sql(mode: str) -> str:
    rolled = "greatest(150 + k * 75 - 200, 0)"
    lo = {"rolling": rolled, "expanding": "0", "hybrid": f"floor({rolled} * 0.5::DOUBLE)"}[mode]
    return f"""ps AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 kk AS (SELECT DISTINCT symbol, n, unnest(range(0, (n - 60 - 150) // 75 + 1)) AS k FROM ps),
 sv AS (SELECT ps.symbol, ts, close, k + 1 AS fold, 'train' AS role FROM ps JOIN kk USING (symbol) WHERE p < 150 + k * 75 AND p >= {lo} UNION ALL
  SELECT ps.symbol, ts, close, k + 1, 'test' FROM ps JOIN kk USING (symbol) WHERE p >= 150 + k * 75 + 5 AND p < least(150 + k * 75 + 65, ps.n)), """ + grid_sql("sv", "symbol, fold, role") + BEST


def walked(spark, d, mode: str):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    return fold_rows(ex.optimise_folds(ex.walk_forward_folds(bars, 200, 60, 150, 5, 10, mode), POINTS))


@query("walk_forward", "X2", with_ctes("bars", walk_sql("rolling")))
def walk_forward(spark, d):
    return walked(spark, d, "rolling")


@query("walk_forward_expanding", "X2", with_ctes("bars", walk_sql("expanding")))
def walk_forward_expanding(spark, d):
    return walked(spark, d, "expanding")


@query("walk_forward_hybrid", "X2", with_ctes("bars", walk_sql("hybrid")))
def walk_forward_hybrid(spark, d):
    return walked(spark, d, "hybrid")


@query("k_fold_metrics", "X4 A16", with_ctes("bars", f"""ps AS (SELECT symbol, ts, close, row_number() OVER ({P}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 f AS (SELECT *, p // (n // 5) AS f FROM ps), g AS (SELECT *, f + 1 AS fold FROM f WHERE f < 5 AND f * (n // 5) - 5 >= 50),
 r AS (SELECT *, coalesce(close / lag(close) OVER k - 1, 0) AS r, close / max(close) OVER (PARTITION BY symbol, fold ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g WINDOW k AS (PARTITION BY symbol, fold ORDER BY ts)),
 m AS (SELECT symbol, fold, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS tr, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sh FROM r GROUP BY symbol, fold)
 SELECT symbol, {", ".join(qnum(f"{fn}({c})", f"{n}_{s}") for c, n in (("tr", "total_return_pct"), ("sh", "sharpe")) for fn, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))} FROM m GROUP BY symbol"""))
def k_fold_metrics(spark, d):
    folded = ex.k_folds(b.bars(spark, d).select("symbol", "ts", "close"), 5, 5)
    m = mx.curve_metrics(folded, Axis(("symbol", "fold"), hot=False), "close")
    s = ex.fold_summary(m, ["symbol"], ["total_return_pct", "sharpe"])
    return s.select("symbol", *nums(*[f"{n}_{k}" for n in ("total_return_pct", "sharpe") for k in ("mean", "std", "min", "max")]))


def u_sql(salt: str, parts: str) -> str:
    return f"((('0x' || substr(md5('42:{salt}:' || {parts}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"


MC = f"""s AS (SELECT symbol, ts, close, row_number() OVER ({P}) - 1 AS rn, greatest(-1, least(1, (105 - close) / 5)) AS sig FROM bars),
 sm AS (SELECT i AS sim, CAST(floor(({u_sql("delay", "i")}) * 4) AS BIGINT) AS dl FROM (SELECT unnest(range(200)) AS i)),
 j AS (SELECT s.symbol, s.ts, s.close, s.rn, sim, dl, z.sig AS sg, s.rn - dl AS src FROM s JOIN sm ON true LEFT JOIN s z ON z.symbol = s.symbol AND z.rn = s.rn - dl),
 nz AS (SELECT *, CASE WHEN src >= 0 THEN greatest(-1, least(1, sg + sqrt(-2 * ln({u_sql("u", "symbol || ':' || sim || ':' || src")})) * cos(2 * pi() * ({u_sql("v", "symbol || ':' || sim || ':' || src")})) * 0.0005::DOUBLE)) ELSE 0 END AS w FROM j),
 k AS (SELECT *, lag(w) OVER q AS w0, lag(close) OVER q AS p0 FROM nz WINDOW q AS (PARTITION BY symbol, sim ORDER BY ts)),
 k2 AS (SELECT *, abs(w - coalesce(w0 * (close / p0) / (1 + w0 * (close / p0 - 1)), 0)) AS tau FROM k),
 k3 AS (SELECT *, 10000 * exp(sum(ln(coalesce(1 - 0.0005::DOUBLE * ltau + w0 * (close / p0 - 1), 1))) OVER (PARTITION BY symbol, sim ORDER BY ts ROWS UNBOUNDED PRECEDING)) * (1 - 0.0005::DOUBLE * tau) AS equity FROM (SELECT *, lag(tau) OVER (PARTITION BY symbol, sim ORDER BY ts) AS ltau FROM k2))"""


def mc_paths(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    bars = bars.withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (105 - F.col("close")) / 5)))
    return ex.simulation(bars, "signal", 200)


@query("monte_carlo_bands", "X5 A11", with_ctes("bars", MC + f""" SELECT symbol, CAST(ts AS VARCHAR) AS ts, {", ".join(qnum(f"quantile_cont(equity, {q / 100})", f"p{q}", 3) for q in (5, 25, 50, 75, 95))} FROM k3 GROUP BY symbol, ts"""))
def monte_carlo_bands(spark, d):
    return ex.percentile_bands(mc_paths(spark, d), ["symbol", "ts"]).select("symbol", text("ts"), *nums("p5", "p25", "p50", "p75", "p95", digits=3))


@query("stress_windows", "X6 P14", with_ctes("bars", f"""w AS (SELECT * FROM (VALUES ('dotcom_burst', DATE '2000-03-10', DATE '2002-10-09'), ('spring_1997', DATE '1997-03-01', DATE '1997-05-31'), ('year_1998', DATE '1998-01-01', DATE '1998-12-31')) v(name, lo, hi)),
 s AS (SELECT symbol, ts, close, name AS scenario, count(*) OVER (PARTITION BY symbol, name) AS n FROM bars JOIN w ON ts BETWEEN lo AND hi),
 r AS (SELECT *, coalesce(close / lag(close) OVER k - 1, 0) AS r, close / max(close) OVER (PARTITION BY symbol, scenario ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM s WHERE n >= 5 WINDOW k AS (PARTITION BY symbol, scenario ORDER BY ts))
 SELECT symbol, scenario, {qnum("(arg_max(close, ts) / arg_min(close, ts) - 1) * 100", "total_return_pct")}, {qnum("min(dd) * 100", "max_drawdown_pct")}, {qnum("coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0)", "sharpe")} FROM r GROUP BY symbol, scenario"""))
def stress_windows(spark, d):
    windows = ex.STRESS_WINDOWS + (("spring_1997", "1997-03-01", "1997-05-31"), ("year_1998", "1998-01-01", "1998-12-31"))
    s = ex.stress_slices(b.bars(spark, d).select("symbol", "ts", "close"), windows)
    m = mx.curve_metrics(s, Axis(("symbol", "scenario"), hot=False), "close")
    return m.select("symbol", "scenario", *nums("total_return_pct", "max_drawdown_pct", "sharpe"))


def curve_sql(name: str, src: str, keys: str, close: str = "close") -> str:
    """Return, drawdown and Sharpe of the curves in ``src``, as the CTE ``name``."""
    k = f"PARTITION BY {keys} ORDER BY ts"
    return f"""{name}_r AS (SELECT *, coalesce({close} / lag({close}) OVER ({k}) - 1, 0) AS r_, {close} / max({close}) OVER ({k} ROWS UNBOUNDED PRECEDING) - 1 AS dd_ FROM {src}),
 {name} AS (SELECT {keys}, (arg_max({close}, ts) / arg_min({close}, ts) - 1) * 100 AS tr, min(dd_) * 100 AS dd, coalesce(avg(r_) / nullif(stddev_samp(r_), 0) * sqrt(252), 0) AS sh FROM {name}_r GROUP BY {keys})"""


STRESSED = """w AS (SELECT * FROM (VALUES ('dotcom_burst', DATE '2000-03-10', DATE '2002-10-09'), ('spring_1997', DATE '1997-03-01', DATE '1997-05-31'), ('year_1998', DATE '1998-01-01', DATE '1998-12-31')) v(name, lo, hi)),
 gb AS (SELECT asset_group, ts, avg(close) AS close FROM bars GROUP BY asset_group, ts),
 so AS (SELECT * FROM (SELECT asset_group, symbol, ts, close, name AS scenario, count(*) OVER (PARTITION BY asset_group, symbol, name) AS n FROM bars JOIN w ON ts BETWEEN lo AND hi) WHERE n >= 5),
 sb AS (SELECT * FROM (SELECT asset_group, ts, close, name AS scenario, count(*) OVER (PARTITION BY asset_group, name) AS n FROM gb JOIN w ON ts BETWEEN lo AND hi) WHERE n >= 5), """


def group_index(bars):
    """Mean close of each asset group per date: the benchmark of its members."""
    return bars.groupBy("asset_group", "ts").agg(F.avg("close").alias("close"))


@query("stress_benchmark", "X6", with_ctes("bars", STRESSED + curve_sql("o", "so", "asset_group, symbol, scenario") + ", " + curve_sql("m", "sb", "asset_group, scenario") + f"""
 SELECT asset_group, symbol, scenario, {qnum("o.tr", "total_return_pct")}, {qnum("o.dd", "max_drawdown_pct")}, {qnum("o.sh", "sharpe")}, {qnum("m.tr", "bench_total_return_pct")}, {qnum("m.dd", "bench_max_drawdown_pct")},
  {qnum("m.sh", "bench_sharpe")}, {qnum("o.tr - m.tr", "excess_return_pct")} FROM o LEFT JOIN m USING (asset_group, scenario)"""))
def stress_benchmark(spark, d):
    windows = ex.STRESS_WINDOWS + (("spring_1997", "1997-03-01", "1997-05-31"), ("year_1998", "1998-01-01", "1998-12-31"))
    bars = b.bars(spark, d).select("asset_group", "symbol", "ts", "close")
    out = ex.stress_report(bars, group_index(bars), "asset_group", windows)
    return out.select("asset_group", "symbol", "scenario", *nums("total_return_pct", "max_drawdown_pct", "sharpe", "bench_total_return_pct", "bench_max_drawdown_pct", "bench_sharpe", "excess_return_pct"))


@query("monte_carlo_summary", "X5", with_ctes("bars", MC + ", " + curve_sql("sm_", "k3", "symbol, sim", "equity") + f""", hd AS (SELECT symbol, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS hr FROM bars GROUP BY symbol)
 SELECT symbol, count(*) AS paths, {qnum("avg(tr)", "mean_return_pct", 4)}, {qnum("stddev_samp(tr)", "std_return_pct", 4)}, {qnum("min(tr)", "worst_return_pct", 4)}, {qnum("max(tr)", "best_return_pct", 4)}, {qnum("min(dd)", "worst_drawdown_pct", 4)},
  {qnum("avg(sh)", "mean_sharpe", 4)}, {qnum("max(hr)", "hold_return_pct", 4)}, {qnum("avg(CASE WHEN tr < 0 THEN 1.0 ELSE 0 END)", "losing_share")}, {qnum("avg(CASE WHEN tr > hr THEN 1.0 ELSE 0 END)", "beating_share")} FROM sm_ JOIN hd USING (symbol) GROUP BY symbol"""))
def monte_carlo_summary(spark, d):
    held = b.bars(spark, d).groupBy("symbol").agg(((F.max_by("close", "ts") / F.min_by("close", "ts") - 1) * 100).alias("hold_return_pct"))
    out = ex.simulation_summary(mc_paths(spark, d), held)
    names = ("mean_return_pct", "std_return_pct", "worst_return_pct", "best_return_pct", "worst_drawdown_pct", "mean_sharpe", "hold_return_pct")
    return out.select("symbol", "paths", *nums(*names, digits=4), *nums("losing_share", "beating_share"))


REVIEWED = "gb AS (SELECT asset_group, ts, avg(close) AS close FROM bars GROUP BY asset_group, ts), " + curve_sql("o", "bars", "asset_group, symbol") + ", " + curve_sql("m", "gb", "asset_group") + """,
 rv AS (SELECT asset_group, symbol, o.tr, o.dd, o.sh, o.tr - m.tr AS ex, o.tr - m.tr < -5 OR o.dd < -40 AS degrading, o.tr - m.tr >= -5 AND o.sh >= -0.5 AND o.dd >= -50 AS kept FROM o JOIN m USING (asset_group))"""


def reviewed(spark, d):
    bars = b.bars(spark, d).select("asset_group", "symbol", "ts", "close")
    return ex.ticker_review(bars, group_index(bars), "asset_group")


@query("ticker_review", "B29", with_ctes("bars", REVIEWED + f""" SELECT asset_group, symbol, {qnum("tr", "return_pct")}, {qnum("dd", "max_drawdown_pct")}, {qnum("sh", "sharpe")}, {qnum("ex", "excess_return_pct")}, degrading, kept FROM rv"""))
def ticker_review(spark, d):
    return reviewed(spark, d).select("asset_group", "symbol", *nums("return_pct", "max_drawdown_pct", "sharpe", "excess_return_pct"), "degrading", "kept")


@query("degradation_report", "B29", with_ctes("bars", REVIEWED + f""" SELECT asset_group, first(symbol ORDER BY dd, symbol) AS worst_drawdown_symbol, {qnum("min(dd)", "worst_drawdown_pct")}, count(*) AS names, count(*) FILTER (degrading) AS degrading,
 count(*) FILTER (NOT kept) AS excluded, {qnum("coalesce(avg(CASE WHEN degrading THEN tr END), 0)", "portfolio_impact_pct")} FROM rv GROUP BY asset_group"""))
def degradation_report(spark, d):
    out = ex.degradation_report(reviewed(spark, d), ["asset_group"])
    return out.select("asset_group", "worst_drawdown_symbol", *nums("worst_drawdown_pct"), "names", "degrading", "excluded", *nums("portfolio_impact_pct"))


OVER = FAMILY + f""", sg AS (SELECT ts, symbol, coalesce(ret, 0) AS r, mom5 AS a, rev1 AS b, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS base FROM i3),
 st AS (SELECT ts, symbol, r, base, 'mom5' AS signal_name, a AS alpha FROM sg UNION ALL SELECT ts, symbol, r, base, 'rev1', b FROM sg),
 x AS (SELECT *, alpha - avg(alpha) OVER (PARTITION BY signal_name, ts) AS x FROM st), t AS (SELECT *, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY signal_name, ts), 0), 0) AS tl FROM x),
 k AS (SELECT t.*, k, greatest(base + k * tl, 0) AS y FROM t, (SELECT unnest([0.05::DOUBLE, 0.2, 0.5]) AS k)), wt AS (SELECT *, y / nullif(sum(y) OVER (PARTITION BY signal_name, k, ts), 0) AS w FROM k),
 dl AS (SELECT signal_name, k, ts, sum(w * r) AS br FROM wt GROUP BY 1, 2, 3),
 mt AS (SELECT ts, coalesce(CASE WHEN count(m) OVER q >= 10 THEN avg(m) OVER q END, 0) AS tr FROM (SELECT ts, avg(kn) AS m FROM i3 GROUP BY ts) WINDOW q AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 fx AS (SELECT signal_name, k, up, down, dl.ts, br * CASE WHEN tr > 0 THEN up ELSE down END AS ret FROM dl JOIN mt USING (ts), (SELECT unnest([1.0::DOUBLE, 1.2]) AS up), (SELECT unnest([0.4::DOUBLE, 1.0]) AS down)),
 pf AS (SELECT signal_name, k, up, down, exp(sum(ln(1 + ret))) - 1 AS total, count(*) AS n, stddev_pop(ret) * sqrt(252) AS vol FROM fx GROUP BY 1, 2, 3, 4),
 ps AS (SELECT *, pow(1 + total, 252.0::DOUBLE / n) - 1 AS annual FROM pf)"""


def family_frame(spark, d):
    df = returns(spark, d)
    ax = checked(df)
    df = windowed(df, lambda x, a: x.withColumn("kn", F.coalesce(prev("ret", a), F.lit(0.0))), ax, lookback=2)
    df = sg.directions(df, "kn", ax)
    df = pf.equal_weight(df, ["ts"], F.lit(True), "base")
    # market trend on the date level: one row per date
    daily = market_trend(spark, d)
    return df.join(daily, "ts")


def market_trend(spark, d):
    df = windowed(returns(spark, d), lambda x, a: x.withColumn("kn", F.coalesce(prev("ret", a), F.lit(0.0))), lookback=2)
    m = df.groupBy("ts").agg(F.avg("kn").alias("m"))
    return m.select("ts", F.coalesce(roll_mean("m", xs.date_axis(), 20, 10), F.lit(0.0)).alias("trend"))


@query("overlay_grid", "X7 B8 B22", with_ctes("bars nb", OVER + f""" SELECT signal_name, {qnums("k", "up", "down", "total", "annual", "vol")}, {qnum("annual / vol + 0.5::DOUBLE * annual - 0.25::DOUBLE * vol", "train_score")} FROM ps"""))
def overlay_grid(spark, d):
    curves = ex.overlay_grid(family_frame(spark, d), ["mom5", "rev1"], "base", "ret", "trend", [0.05, 0.2, 0.5], [1.0, 1.2], [0.4, 1.0])
    s = ex.train_score(mx.compact_stats(curves, ["signal_name", "k", "up", "down"], "ret"))
    return s.select("signal_name", *nums("k", "up", "down", "total", "annual", "vol", "train_score"))


def mixed_sql(by: str, mode: str, mix: float) -> str:
    """Weights of one mode and mix over ``x`` (alpha) and ``base``, as the last of a chain of CTEs named after ``by``."""
    lo, size, part = ("-0.08", "abs({0})", "PARTITION BY candidate, ts") if mode == "ls" else ("0", "{0}", "PARTITION BY candidate, ts")
    cap = "0.08" if mode == "ls" else "0.15"
    first = f"x - avg(x) OVER ({part})" if mode == "ls" else "greatest(x, 0)"
    floor = "{0}" if mode == "ls" else "greatest({0}, 0)"
    norm = lambda c: f"coalesce({c} / nullif(sum({size.format(c)}) OVER ({part}), 0), 0)"
    out = f""" {by}0 AS (SELECT candidate, ts, r, base, {first} AS v FROM al), {by}1 AS (SELECT * REPLACE ({norm("v")} AS v) FROM {by}0), {by}2 AS (SELECT * REPLACE (greatest({lo}::DOUBLE, least({cap}::DOUBLE, v)) AS v) FROM {by}1),
 {by}3 AS (SELECT * REPLACE ({norm("v")} AS v) FROM {by}2)"""
    if mix:
        out += f""", {by}4 AS (SELECT * REPLACE ({floor.format(f"({1 - mix}::DOUBLE * v + {mix}::DOUBLE * base)")} AS v) FROM {by}3), {by}5 AS (SELECT * REPLACE ({norm("v")} AS v) FROM {by}4)"""
    return out


VARIANTS = {"ls|mix0.00": ("la", "ls", 0.0), "ls|mix0.25": ("lb", "ls", 0.25), "long|mix0.00": ("ga", "long", 0.0), "long|mix0.25": ("gb", "long", 0.25)}
CANDIDATES = FAMILY + """, sg AS (SELECT ts, symbol, coalesce(ret, 0) AS r, mom5, rev1, resid_rev, CASE WHEN volume > 25 THEN 1.0::DOUBLE ELSE 0 END AS busy, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS base FROM i3),
 al AS (""" + " UNION ALL ".join(f"SELECT '{g}|{s}' AS candidate, ts, r, base, coalesce({('busy * ' if g == 'busy' else '') + s}, 0) AS x FROM sg" for g in ("flat", "busy") for s in ("mom5", "rev1", "resid_rev")) + "), " + ", ".join(
    mixed_sql(by, mode, mix) for by, mode, mix in VARIANTS.values()) + ", dl AS (" + " UNION ALL ".join(
    f"SELECT candidate || '|{name}' AS candidate, ts, sum(v * r) AS ret FROM {by}{5 if mix else 3} GROUP BY 1, 2" for name, (by, _, mix) in VARIANTS.items()) + """),
 pf AS (SELECT candidate, exp(sum(ln(1 + ret))) - 1 AS total, count(*) AS n, stddev_pop(ret) * sqrt(252) AS vol FROM dl GROUP BY candidate), ps AS (SELECT *, pow(1 + total, 252.0::DOUBLE / n) - 1 AS annual FROM pf)"""


@query("candidate_matrix", "X8 B5", with_ctes("bars nb", CANDIDATES + f""" SELECT candidate, {qnum("ln(1 + total)", "log_total")}, {qnums("annual", "vol")}, {qnum("CASE WHEN vol > 0 THEN annual / vol ELSE 0 END", "sharpe")} FROM ps"""))
def candidate_matrix(spark, d):
    df = family_frame(spark, d).withColumns({"flat": F.lit(1.0), "busy": (F.col("volume") > 25).cast("double")})
    c = ex.candidate_returns(df, ["flat", "busy"], ["mom5", "rev1", "resid_rev"], "base", "ret", [0.0, 0.25])
    s = mx.compact_stats(c, ["candidate"], "ret")
    return s.select("candidate", num(F.log1p("total")).alias("log_total"), *nums("annual", "vol", "sharpe"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def picked_sql(prefix: str, name: str = "z.pick") -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{r}' THEN {prefix}{i}" for i, r in enumerate(REGIONS)) + " END"


KEEP = f"CASE WHEN {picked_sql('s')} >= top - 0.15::DOUBLE THEN z.pick ELSE best END"


@query("rolling_selector", "B34 scan", with_ctes("bars nb", f"""c AS (SELECT asset_group AS candidate, ts, avg(coalesce(ret, 0)) AS ret FROM nb GROUP BY 1, 2),
 dz AS (SELECT DISTINCT ts FROM nb), dd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM dz),
 g AS (SELECT n.candidate, ts, rn, coalesce(c.ret, 0) AS ret FROM dd JOIN (SELECT unnest({list(REGIONS)}) AS candidate) n ON true LEFT JOIN c USING (candidate, ts)),
 s AS (SELECT *, coalesce(avg(ret) OVER w / nullif(stddev_pop(ret) OVER w, 0) * sqrt(252), -1e9) AS sc FROM g WINDOW w AS (PARTITION BY candidate ORDER BY ts ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING)),
 b AS (SELECT ts, rn, max(sc) AS top, arg_max(candidate, sc) AS best, {", ".join(f"max(CASE WHEN candidate = '{r}' THEN sc END) AS s{i}, max(CASE WHEN candidate = '{r}' THEN ret END) AS r{i}" for i, r in enumerate(REGIONS))} FROM s GROUP BY ts, rn),
 z AS (SELECT ts, rn, 'ASIA' AS pick, r2 AS ret FROM b WHERE rn = 0 UNION ALL
  SELECT ts, rn, pick, {picked_sql("r", "pick")} FROM (SELECT b.*, CASE WHEN b.rn < 80 THEN 'ASIA' ELSE {KEEP} END AS pick FROM z JOIN b ON b.rn = z.rn + 1))
 SELECT CAST(ts AS VARCHAR) AS ts, pick, {qnum("ret", "ret")} FROM z"""))
def rolling_selector(spark, d):
    df = returns(spark, d)
    per = df.groupBy("ts").agg(*[F.coalesce(F.avg(F.when(F.col("asset_group") == n, F.coalesce("ret", F.lit(0.0)))), F.lit(0.0)).alias(n) for n in REGIONS])
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(n).alias("ret")) for n in REGIONS])
    long = per.select("ts", F.explode(rows).alias("_e")).select("ts", "_e.candidate", "_e.ret")
    return ex.rolling_selector(long, "ASIA").select(text("ts"), "pick", num("ret").alias("ret"))


@query("permutation_path", "X9", with_ctes("bars nb", f"""q AS (SELECT symbol, ts, rn - 1 AS p, ret, first(close) OVER ({P}) AS c0 FROM nb),
 h AS (SELECT *, {u_sql("u", "symbol || ':' || p").replace("42:", "999:")} AS u FROM q WHERE p > 0),
 k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY u) AS slot, ret AS shuffled FROM h)
 SELECT h.symbol, CAST(h.ts AS VARCHAR) AS ts, {qnum("shuffled", "shuffled")}, {qnum("c0 * exp(sum(ln(1 + shuffled)) OVER (PARTITION BY h.symbol ORDER BY h.ts ROWS UNBOUNDED PRECEDING))", "close")} FROM h JOIN k ON k.symbol = h.symbol AND k.slot = h.p"""))
def permutation_path(spark, d):
    return ex.permuted_path(returns(spark, d), "ret").select("symbol", text("ts"), *nums("shuffled", "close"))


@query("overfit_verdicts", "X10", with_ctes("bars nb", f"""r AS (SELECT asset_group, symbol, CASE WHEN year(ts) < 1998 THEN 'train' WHEN year(ts) < 2000 THEN 'test' ELSE 'random' END AS kind, (exp(sum(ln(1 + coalesce(ret, 0)))) - 1) * 100 AS return_pct,
   avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM nb GROUP BY 1, 2, 3),
 g AS (SELECT asset_group, avg(CASE WHEN kind = 'train' THEN return_pct END) - avg(CASE WHEN kind = 'test' THEN return_pct END) AS gr, avg(CASE WHEN kind = 'train' THEN sharpe END) - avg(CASE WHEN kind = 'test' THEN sharpe END) AS gs,
   stddev_samp(CASE WHEN kind = 'test' THEN return_pct END) AS rs, stddev_samp(CASE WHEN kind = 'test' THEN sharpe END) AS ss,
   (avg(CASE WHEN kind = 'test' THEN return_pct END) - avg(CASE WHEN kind = 'random' THEN return_pct END)) / (stddev_samp(CASE WHEN kind = 'random' THEN return_pct END) + 1e-8) AS z FROM r GROUP BY asset_group)
 SELECT asset_group, {qnum("gr", "gap_return")}, {qnum("z", "z_random")}, abs(gr) > 50 OR abs(gs) > 1 AS overfit, rs > 20 OR ss > 0.5 AS unstable, abs(z) < 1 AS random_like FROM g"""))
def overfit_verdicts(spark, d):
    from tidemark.operators.backtest import compound

    y = F.year("ts")
    runs = returns(spark, d).groupBy("asset_group", "symbol", F.when(y < 1998, "train").when(y < 2000, "test").otherwise("random").alias("kind")).agg(
        ((F.exp(F.sum(compound("ret"))) - 1) * 100).alias("return_pct"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return ex.overfit_verdicts(runs, ["asset_group"]).select("asset_group", *nums("gap_return", "z_random"), "overfit", "unstable", "random_like")


@query("forecast_accuracy", "X11", with_ctes("bars nb", f"""e AS (SELECT *, CASE WHEN pc IS NOT NULL THEN abs(close - pc) END AS err, abs(close - lag(close) OVER ({P})) AS nv FROM nb),
 m AS (SELECT symbol, avg(err) / avg(nv) AS mase, avg(2 * err / (abs(close) + abs(pc))) * 100 AS smape FROM e WHERE pc IS NOT NULL GROUP BY symbol)
 SELECT symbol, {qnums("mase", "smape")}, {qnum("0.5::DOUBLE * (mase + smape / 100)", "owa")} FROM m"""))
def forecast_accuracy(spark, d):
    bars = b.bars(spark, d)
    ax = checked(bars)
    df = windowed(bars, lambda x, a: x.withColumn("predicted", prev("close", a)), ax, lookback=1)
    return ex.forecast_accuracy(df, ax, "close", "predicted").select("symbol", *nums("mase", "smape", "owa"))


@query("ticker_split", "B30 W14 W15", with_ctes("bars nb", f"""s AS (SELECT symbol, avg(ret) AS v, {u_sql("u", "symbol")} AS u FROM nb GROUP BY symbol),
 e AS (SELECT quantile_cont(v, [0.0::DOUBLE, 1.0::DOUBLE / 3, 2.0::DOUBLE / 3, 1.0::DOUBLE]) AS e FROM s),
 b AS (SELECT *, CAST(greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) AS INTEGER) AS stratum FROM s, e)
 SELECT symbol, stratum, row_number() OVER (PARTITION BY stratum ORDER BY u) - 1 < greatest(1, floor(count(*) OVER (PARTITION BY stratum) * 0.3::DOUBLE)) AS is_test, u < 0.5 AS in_first_half FROM b"""))
def ticker_split(spark, d):
    stats = returns(spark, d).groupBy("symbol").agg(F.avg("ret").alias("v"))
    return ex.half_split(ex.ticker_split(stats, "v")).select("symbol", "stratum", "is_test", "in_first_half")


@query("strategy_ranking", "X12 P22", with_ctes("bars nb", f"""m AS (SELECT asset_group, symbol, exp(sum(ln(1 + coalesce(ret, 0)))) - 1 AS total FROM nb GROUP BY 1, 2),
 b AS (SELECT exp(sum(ln(1 + mk))) - 1 AS bt FROM (SELECT ts, avg(coalesce(ret, 0)) AS mk FROM nb GROUP BY ts))
 SELECT symbol, {qnum("total - bt", "excess")}, rank() OVER (ORDER BY total DESC) AS place FROM m, b"""))
def strategy_ranking(spark, d):
    from pyspark.sql import Window

    from tidemark.operators.backtest import compound

    r = returns(spark, d)
    m = r.groupBy("symbol").agg((F.exp(F.sum(compound("ret"))) - 1).alias("total"))
    bench = r.groupBy("ts").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("mk")).agg((F.exp(F.sum(compound("mk"))) - 1).alias("bt"))
    top = m.join(F.broadcast(bench))  # one row: the benchmark's total return
    return top.select("symbol", num(F.col("total") - F.col("bt")).alias("excess"), F.rank().over(Window.orderBy(F.desc("total"))).cast("long").alias("place"))


# --- micro-structure -------------------------------------------------------------------------


@query("flow_and_vpin", "M3 M4", with_ctes("trades", f"""c AS (SELECT *, sum(quantity) OVER (PARTITION BY symbol ORDER BY trade_time, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades),
 t AS (SELECT symbol, sum(quantity) AS total, CAST(floor(sum(quantity) / 5000) AS BIGINT) AS n FROM trades GROUP BY symbol),
 k AS (SELECT c.*, least(CAST(ceil(cum * n / total) AS BIGINT), n) AS bucket FROM c JOIN t USING (symbol)),
 f AS (SELECT symbol, bucket, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS bq, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sq FROM k GROUP BY 1, 2),
 g AS (SELECT symbol, unnest(range(1, n + 1)) AS bucket FROM t)
 SELECT symbol, bucket, {qnum("coalesce(abs(bq - sq) / nullif(bq + sq, 0), 0)", "vpin")} FROM g LEFT JOIN f USING (symbol, bucket)"""))
def flow_and_vpin(spark, d):
    return ms.vpin(b.trades(spark, d), 5000.0).select("symbol", "bucket", num("vpin").alias("vpin"))


@query("order_flow_imbalance", "M3 A1", with_ctes("trades", f"""h AS (SELECT symbol, date_trunc('hour', trade_time) AS h, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS bq, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sq FROM trades GROUP BY 1, 2)
 SELECT symbol, CAST(h AS VARCHAR) AS ts, {qnum("CASE WHEN bq + sq > 0 THEN (bq - sq) / (bq + sq) ELSE 0 END", "imbalance")} FROM h"""))
def order_flow_imbalance(spark, d):
    f = ms.trade_features(b.trades(spark, d), "1 hour")
    return f.select("symbol", text("ts"), num(ms.flow_imbalance("buy_qty", "sell_qty")).alias("imbalance"))


@query("micro_merge", "M1 M2 J1 J9 P5", with_ctes("intraday trades", f"""f AS (SELECT symbol, date_trunc('hour', trade_time) AS ts, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS bq, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sq FROM trades GROUP BY 1, 2),
 fr AS (SELECT symbol, trade_time + INTERVAL 1 MINUTE AS ts, arg_max(quantity, trade_id) / 1e4 AS fr FROM trades GROUP BY 1, 2), oi AS (SELECT symbol, trade_time AS ts, arg_max(price, trade_id) AS oi FROM trades GROUP BY 1, 2),
 j AS (SELECT i.symbol, i.ts, i.close, fr.fr, oi.oi FROM intraday i ASOF LEFT JOIN fr ON i.symbol = fr.symbol AND i.ts >= fr.ts ASOF LEFT JOIN oi ON i.symbol = oi.symbol AND i.ts >= oi.ts),
 k AS (SELECT j.symbol, j.ts, close, fr, oi, last_value(bq IGNORE NULLS) OVER u AS bq, last_value(sq IGNORE NULLS) OVER u AS sq FROM j LEFT JOIN f ON f.symbol = j.symbol AND f.ts = j.ts WINDOW u AS (PARTITION BY j.symbol ORDER BY j.ts ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret FROM k)
 {SEL}, {qnum("fr", "funding_rate")}, {qnum("oi", "open_interest")}, {qnum(f"(fr - ({roll('avg', 'fr', 50)})) / (({roll('stddev_samp', 'fr', 50)}) + 1e-8)", "funding_z")}, {qnum(f"coalesce(oi / lag(oi) OVER ({P}) - 1, 0)", "oi_change")},
 {qnum("(bq - sq) / (bq + sq + 1e-8)", "trade_imbalance")}, {qnum(roll("stddev_samp", "ret", 20), "volatility")}, {qnum(f"close / (({roll('avg', 'close', 20)}) + 1e-8)", "momentum")} FROM r"""))
def micro_merge(spark, d):
    t = b.trades(spark, d)
    # one reading per instant: the last trade of it
    latest = t.groupBy("symbol", "trade_time").agg(F.max_by(F.struct("quantity", "price"), "trade_id").alias("l"))
    funding = latest.select("symbol", (F.col("trade_time") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), (F.col("l.quantity") / 1e4).alias("funding_rate"))
    interest = latest.select("symbol", F.col("trade_time").alias("ts"), F.col("l.price").alias("open_interest"))
    flow = ms.trade_features(t, "1 hour")
    df = ms.merge_micro(b.intraday(spark, d).select("symbol", "ts", "close"), funding, interest, flow)
    return df.select("symbol", text("ts"), *nums("funding_rate", "open_interest", "funding_z", "oi_change", "trade_imbalance", "volatility", "momentum"))


SWEEP = f"""e AS (SELECT *, {roll("min", "low", 20)} AS sl, {roll("max", "high", 20)} AS sh, max(high) OVER {frame(20)} AS ph, min(low) OVER {frame(20)} AS pl FROM intraday),
 f AS (SELECT *, lag(sl) OVER o AS l1, lag(sl, 2) OVER o AS l2, lag(sh) OVER o AS h1, lag(sh, 2) OVER o AS h2, lag(low) OVER o AS low1, lag(high) OVER o AS high1, lag(ph) OVER o AS ph1, lag(pl) OVER o AS pl1 FROM e WINDOW o AS ({P})),
 f2 AS (SELECT *, CASE WHEN coalesce(close > l1, false) THEN 1 ELSE 0 END AS il, CASE WHEN coalesce(close < h1, false) THEN 1 ELSE 0 END AS ih FROM f),
 g AS (SELECT *, coalesce(low < l1 AND low1 >= l2 AND l1 - low > l1 * 0.0008 AND max(il) OVER q > 0 AND count(*) OVER q >= 5, false) AS ll, coalesce(high > h1 AND high1 <= h2 AND high - h1 > h1 * 0.0008 AND max(ih) OVER q > 0 AND count(*) OVER q >= 5, false) AS ss
   FROM f2 WINDOW q AS ({P} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 h AS (SELECT *, CASE WHEN ll THEN greatest(0, least(1, (l1 - low) / l1 * 100)) ELSE 0 END AS ql, CASE WHEN ss THEN greatest(0, least(1, (high - h1) / h1 * 100)) ELSE 0 END AS qs, coalesce(close > ph1 AND (close - ph1) / ph1 > 0.0005, false) AS mb, coalesce(close < pl1 AND (pl1 - close) / pl1 > 0.0005, false) AS mb2,
   max(CASE WHEN ll THEN 1 ELSE 0 END) OVER {frame(40)} > 0 AS hl, max(CASE WHEN ss THEN 1 ELSE 0 END) OVER {frame(40)} > 0 AS hs FROM g),
 m AS (SELECT *, CASE WHEN mb AND hl THEN greatest(0, least(1, (close - ph1) / ph1 * 100 / 0.1)) ELSE 0 END AS qb, CASE WHEN mb2 AND hs THEN greatest(0, least(1, (pl1 - close) / pl1 * 100 / 0.1)) ELSE 0 END AS qbs FROM h)"""


@query("liquidity_structure", "M5 M6", with_ctes("intraday", SWEEP + f""" {SEL}, ll AS liq_capture_long, ss AS liq_capture_short, {qnum("ql", "liq_quality_long")}, {qnum("qs", "liq_quality_short")}, mb AS msb_bullish, mb AND hl AS msb_bullish_valid, mb2 AND hs AS msb_bearish_valid, {qnum("qb", "msb_quality_bullish")}, {qnum("qbs", "msb_quality_bearish")} FROM m"""))
def liquidity_structure(spark, d):
    df = windowed(b.intraday(spark, d), lambda x, a: ms.structure_break(ms.liquidity_capture(x, a), a), lookback=70, lookahead=5)
    return df.select("symbol", text("ts"), "liq_capture_long", "liq_capture_short", *nums("liq_quality_long", "liq_quality_short"), "msb_bullish", "msb_bullish_valid", "msb_bearish_valid", *nums("msb_quality_bullish", "msb_quality_bearish"))


@query("confluence_score", "M7 M8 J4", with_ctes("intraday", SWEEP + """,
 v AS (SELECT symbol, ts, close, volume, sum(close * volume) OVER s / sum(volume) OVER s AS vwap FROM intraday WINDOW s AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 tb AS (SELECT ts, (close - vwap) / vwap AS tn, 100 * (close - vwap) / vwap AS dist FROM v WHERE symbol = 'click'), rb AS (SELECT ts, volume / 10 AS gm, close < vwap * 1.5 AS un, close > vwap * 0.5::DOUBLE AS ov FROM v WHERE symbol = 'view'),
 x AS (SELECT m.*, v.vwap, 100 * (m.close - v.vwap) / v.vwap AS vd, (m.close - v.vwap) / v.vwap AS dn FROM m JOIN v USING (symbol, ts)),
 y AS (SELECT x.*, tb.tn, tb.dist, rb.gm, rb.un, rb.ov FROM x ASOF LEFT JOIN tb ON x.ts >= tb.ts ASOF LEFT JOIN rb ON x.ts >= rb.ts),
 z AS (SELECT *, coalesce(tn > 0.05 AND dist > -1.5, false) AS tl, coalesce(un AND gm > 0.3, false) AS rl, max(ql) OVER """ + frame(40) + """ AS mq FROM y),
 sc AS (SELECT *, round(CASE WHEN hl THEN 30 * (0.5 + 0.5 * mq) ELSE 0 END + CASE WHEN mb AND hl THEN 30 * (0.5 + 0.5 * qb) ELSE 0 END
   + (CASE WHEN abs(vd) < 0.5 THEN 1.0 WHEN abs(vd) < 1 THEN 0.8 WHEN abs(vd) < 2 THEN 0.5 WHEN abs(vd) < 3 THEN 0.2 ELSE 0 END) * CASE WHEN vd > 0 THEN 1.0 ELSE 0.7 END * 20
   + CASE WHEN tl THEN 10 * (0.5 + 0.5 * greatest(0, least(0.3, tn)) / 0.3) ELSE 0 END + CASE WHEN rl THEN 5 ELSE 0 END + CASE WHEN dn > 0.1 THEN 5 * greatest(0, least(1, dn)) ELSE 0 END, 1) AS score FROM z)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, tl AS spy_long_ok, rl AS qqq_long_ok, """ + qnum("score", "score_long", 1) + ", CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'B' ELSE '-' END AS rating_long FROM sc"))
def confluence_score(spark, d):
    df = windowed(b.intraday(spark, d), lambda x, a: ms.structure_break(ms.liquidity_capture(x, a), a), lookback=70, lookahead=5)
    df = anchored_vwap(df).withColumn("delta_norm", ratio(F.col("close") - F.col("vwap"), "vwap"))
    base = anchored_vwap(b.intraday(spark, d).where("symbol IN ('click', 'view')"))
    base = base.withColumns({"delta_norm": ratio(F.col("close") - F.col("vwap"), "vwap"), "gamma_magnitude": F.col("volume") / 10,
                             "vwap_upper_2": F.col("vwap") * 1.5, "vwap_lower_2": F.col("vwap") * 0.5})
    df = ms.confluence(df, base.where("symbol = 'click'"), base.where("symbol = 'view'"))
    df = windowed(df, lambda x, a: x.withColumn("score_long", ms.quality_score(a, "long")), lookback=40)
    return df.select("symbol", text("ts"), "spy_long_ok", "qqq_long_ok", num("score_long", 1).alias("score_long"), ms.rating("score_long").alias("rating_long"))


@query("session_patterns", "M9 M10 M11 G9", with_ctes("intraday", f"""k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS kb, lag(close) OVER ({P}) AS c1, lag(day) OVER ({P}) AS d1,
   sum(CASE WHEN close > c0 THEN volume WHEN close < c0 THEN -volume ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cd FROM (SELECT *, lag(close) OVER ({P}) AS c0 FROM intraday)),
 o AS (SELECT *, max(CASE WHEN kb <= 6 THEN high END) OVER (PARTITION BY symbol, day) AS oh, min(CASE WHEN kb <= 6 THEN low END) OVER (PARTITION BY symbol, day) AS ol, CASE WHEN day <> d1 THEN open / c1 - 1 END AS gap,
   {roll("max", "high", 20)} AS p20, {roll("min", "low", 20)} AS l20, {roll("max", "cd", 20)} AS ch, {roll("min", "cd", 20)} AS cl FROM k)
 {SEL}, {qnum("oh", "orb_high")}, {qnum("ol", "orb_low")}, coalesce(max(CASE WHEN gap > 0.003 THEN 1 ELSE 0 END) OVER {frame(41)} > 0, false) AS gap_up, coalesce(max(CASE WHEN gap < -0.003 THEN 1 ELSE 0 END) OVER {frame(41)} > 0, false) AS gap_down,
 coalesce(high >= lag(p20) OVER ({P}) AND cd < lag(ch, 5) OVER ({P}), false) AS bear_div, coalesce(low <= lag(l20) OVER ({P}) AND cd > lag(cl, 5) OVER ({P}), false) AS bull_div,
 coalesce(close > lag(oh) OVER ({P}) AND kb > 6, false) AS orb_long FROM o"""))
def session_patterns(spark, d):
    df = volume_delta(anchored_vwap(b.intraday(spark, d)))
    df = ms.opening_range(df)

    def add(x, a):
        x = ms.delta_divergence(ms.gap_flags(x, a), a)
        return x.withColumn("orb_long", sg.opening_breakout(a, "long"))

    df = windowed(df, add, lookback=60)
    return df.select("symbol", text("ts"), *nums("orb_high", "orb_low"), "gap_up", "gap_down", "bear_div", "bull_div", "orb_long")


WAITS = {"vwap_reversion": 10, "opening_range": 10, "gap_fill": 10, "delta_divergence": 30, "vwap_pullback": 20}
ENTRIES = [(f"{n}_{s}", w) for n, w in WAITS.items() for s in ("long", "short")]
DAY = "(PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)"
RULES = f"""k0 AS (SELECT *, lag(close) OVER ({P}) AS c0, lag(day) OVER ({P}) AS d1, row_number() OVER ({P}) AS rn, coalesce(close / lag(close, 10) OVER ({P}) - 1, 0) AS dp FROM intraday),
 k1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS kb, sum(CASE WHEN close > c0 THEN volume WHEN close < c0 THEN -volume ELSE 0 END) OVER {DAY} AS cd, sum(close * volume) OVER {DAY} / sum(volume) OVER {DAY} AS vwap FROM k0),
 {ewm_sql("k1", {"ds": ("dp", span(10))})},
 k2 AS (SELECT k1.*, ds, coalesce(stddev_samp(close - vwap) OVER {DAY}, 0) AS sd, max(abs(ds)) OVER {frame(20)} AS dmax, max(CASE WHEN kb <= 6 THEN high END) OVER (PARTITION BY symbol, day) AS oh, min(CASE WHEN kb <= 6 THEN low END) OVER (PARTITION BY symbol, day) AS ol,
  CASE WHEN day <> d1 THEN open / c0 - 1 END AS gap, {roll("max", "high", 20)} AS ph, {roll("min", "low", 20)} AS pl, {roll("max", "cd", 20)} AS ch, {roll("min", "cd", 20)} AS cl FROM k1 JOIN ew USING (symbol, rn)),
 k3 AS (SELECT *, coalesce(greatest(-1, least(1, ds / (CASE WHEN dmax = 0 THEN 0.001 ELSE dmax END))), 0) AS dn, 100 * (close - vwap) / vwap AS vd FROM k2),
 k4 AS (SELECT symbol, ts, rn, coalesce(close < vwap - 2 * sd, false) AS vwap_reversion_long, coalesce(close > vwap + 2 * sd, false) AS vwap_reversion_short,
  coalesce(close > lag(oh) OVER ({P}) AND kb > 6, false) AS opening_range_long, coalesce(close < lag(ol) OVER ({P}) AND kb > 6, false) AS opening_range_short,
  coalesce(max(CASE WHEN gap < -0.003 THEN 1 ELSE 0 END) OVER {frame(41)} > 0, false) AND kb > 1 AS gap_fill_long, coalesce(max(CASE WHEN gap > 0.003 THEN 1 ELSE 0 END) OVER {frame(41)} > 0, false) AND kb > 1 AS gap_fill_short,
  coalesce(low <= lag(pl) OVER ({P}) AND cd > lag(cl, 5) OVER ({P}), false) AS delta_divergence_long, coalesce(high >= lag(ph) OVER ({P}) AND cd < lag(ch, 5) OVER ({P}), false) AS delta_divergence_short,
  coalesce(count(*) OVER {frame(10)} >= 5 AND max(CASE WHEN vd > 1.5 AND dn > 0.2 THEN 1 ELSE 0 END) OVER {frame(10)} > 0 AND abs(vd) < 0.3 AND close > c0, false) AS vwap_pullback_long,
  coalesce(count(*) OVER {frame(10)} >= 5 AND max(CASE WHEN vd < -1.5 AND dn < -0.2 THEN 1 ELSE 0 END) OVER {frame(10)} > 0 AND abs(vd) < 0.3 AND close < c0, false) AS vwap_pullback_short FROM k3),
 r AS (SELECT symbol, ts, rn, {", ".join(f"{n} AS e_{n}, CASE WHEN {n} THEN rn ELSE -1000000 END AS l_{n}" for n, _ in ENTRIES)} FROM k4 WHERE rn = 1 UNION ALL
  SELECT k4.symbol, k4.ts, k4.rn, {", ".join(f"{n} AND k4.rn - l_{n} >= {w}, CASE WHEN {n} AND k4.rn - l_{n} >= {w} THEN k4.rn ELSE l_{n} END" for n, w in ENTRIES)} FROM r JOIN k4 ON k4.symbol = r.symbol AND k4.rn = r.rn + 1)"""


@query("entry_rules", "G9 G8", with_ctes("intraday", RULES + f""" {SEL}, {", ".join(f"e_{n} AS entry_{n}" for n, _ in ENTRIES)} FROM r"""))
def entry_rules(spark, d):
    df = volume_delta(anchored_vwap(b.intraday(spark, d)))
    df = sensitivity_proxies(ms.opening_range(df))
    out = sg.entry_rules(df, F.lit(True))
    return out.select("symbol", text("ts"), *[c for c in out.columns if c.startswith("entry_")])
