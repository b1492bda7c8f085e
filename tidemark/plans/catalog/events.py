"""Event flags, regimes, point processes, fractal and spectral statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hawkes as hk
from tidemark.operators import regimes as rg
from tidemark.operators import spectra as sp
from tidemark.operators import volatility as vol
from tidemark.operators.frames import Frame, Frames, framed, with_frames
from tidemark.operators.series import BARS, Axis, checked, pct_change, positions, windowed
from tidemark.plans.catalog.portfolio import returns
from tidemark.plans.catalog.windows import P, SEL, frame, roll
from tidemark.plans.registry import num, nums, qnum, qnums, query, text, with_ctes
from tidemark.sources import bindings as b


@query("variance_breakouts", "R2 A9", with_ctes("bars nb", f"""r AS (SELECT *, sqrt({roll("sum", "lr * lr", 20)}) AS rv FROM nb), t AS (SELECT symbol, avg(rv) + 2 * stddev_samp(rv) AS th FROM r GROUP BY symbol)
 {SEL}, {qnum("rv", "rv")}, {qnum("th", "threshold")} FROM r JOIN t USING (symbol) WHERE rv > th"""))
def variance_breakouts(spark, d):
    return rg.variance_breakouts(b.bars(spark, d)).select("symbol", text("ts"), *nums("rv", "threshold"))


@query("cusum_breakouts", "R3 scan", with_ctes("bars nb", f"""s AS (SELECT symbol, ts, rn, lr, stddev_samp(lr) OVER (PARTITION BY symbol) AS sd FROM nb),
 r AS (SELECT symbol, ts, rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, NULL::DOUBLE AS stat, false AS ev FROM s WHERE rn = 1 UNION ALL
  SELECT symbol, ts, rn, CASE WHEN greatest(u, d) > 5 * sd THEN 0 ELSE u END, CASE WHEN greatest(u, d) > 5 * sd THEN 0 ELSE d END, greatest(u, d), greatest(u, d) > 5 * sd
   FROM (SELECT s.symbol, s.ts, s.rn, s.sd, greatest(0, r.up + s.lr - 0.5 * s.sd) AS u, greatest(0, r.dn - s.lr - 0.5 * s.sd) AS d FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1))
 {SEL}, {qnum("stat", "cusum")}, ev AS cusum_event FROM r"""))
def cusum_breakouts(spark, d):
    return rg.cusum_breakouts(b.bars(spark, d)).select("symbol", text("ts"), num("cusum").alias("cusum"), "cusum_event")


EVT = """ev0 AS (SELECT symbol, ts, lr, stddev_pop(lr) OVER (PARTITION BY symbol) AS sd, min(ts) OVER (PARTITION BY symbol) AS t0, max(ts) OVER (PARTITION BY symbol) AS t9 FROM nb),
 evt AS (SELECT DISTINCT symbol, CASE WHEN lr < -1.5::DOUBLE * sd THEN 0 ELSE 1 END AS kind, CAST((ts - t0) * 86400 AS DOUBLE) AS t FROM ev0 WHERE abs(lr) > 1.5::DOUBLE * sd)"""


@query("sigma_events", "R4 D12", with_ctes("bars nb", EVT + f""" SELECT symbol, kind, {qnum("t", "t")} FROM evt"""))
def sigma_events(spark, d):
    return rg.sigma_events(b.bars(spark, d), 1.5).select("symbol", "kind", num("t").alias("t"))


QL = f"""v AS (SELECT *, {roll("stddev_samp", "lr", 20)} * sqrt(252) AS rv FROM nb), e AS (SELECT symbol, quantile_cont(rv, 1.0::DOUBLE / 3) AS a, quantile_cont(rv, 2.0::DOUBLE / 3) AS z FROM v GROUP BY symbol),
 l AS (SELECT v.*, CASE WHEN rv IS NULL THEN 0 WHEN rv < a THEN 0 WHEN rv < z THEN 1 ELSE 2 END AS vol_regime FROM v JOIN e USING (symbol))"""


@query("quantile_regimes", "R5 R6 R15 W16", with_ctes("bars nb", QL + f""" SELECT symbol, vol_regime, CASE vol_regime WHEN 0 THEN 'low_vol' WHEN 1 THEN 'medium_vol' ELSE 'high_vol' END AS name, {qnum("avg(rv)", "mean_vol")}, {qnum("avg(ret)", "mean_return", 8)},
 {qnum("count(*) / sum(count(*)) OVER (PARTITION BY symbol)", "frequency")} FROM l GROUP BY symbol, vol_regime"""))
def quantile_regimes(spark, d):
    g = rg.regime_profile(rg.quantile_labels(b.bars(spark, d)), ["symbol"])
    return g.select("symbol", "vol_regime", "name", num("mean_vol").alias("mean_vol"), num("mean_return", 8).alias("mean_return"), num("frequency").alias("frequency"))


@query("regimes_with_volatility", "R15 R16", with_ctes("bars nb", QL + f""" {SEL}, {qnum("ret", "ret")}, {qnum("rv", "rv")}, vol_regime, {qnum("CASE vol_regime WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END", "signal")} FROM l"""))
def regimes_with_volatility(spark, d):
    from tidemark.operators.signals import regime_signal

    df = rg.quantile_labels(b.bars(spark, d))
    name = F.element_at(F.array(*[F.lit(n) for n in rg.NAMES]), F.col("vol_regime") + 1)
    return df.select("symbol", text("ts"), *nums("ret", "rv"), "vol_regime", num(regime_signal(name)).alias("signal"))


@query("market_regime", "R7", with_ctes("bars nb", f"""m AS (SELECT ts, avg(ret) AS mkt FROM nb GROUP BY ts), v AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n, CASE WHEN count(mkt) OVER w >= 10 THEN stddev_samp(mkt) OVER w END AS mv FROM m WINDOW w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 t AS (SELECT quantile_cont(CASE WHEN p < floor(n * 0.7::DOUBLE) THEN mv END, 0.5) AS md FROM v)
 SELECT CAST(ts AS VARCHAR) AS ts, {qnum("mkt", "mkt")}, {qnum("mv", "mkt_vol")}, CASE WHEN coalesce(mv >= md, false) THEN 1 ELSE 0 END AS high_vol FROM v, t"""))
def market_regime(spark, d):
    return rg.market_regime(returns(spark, d), "ret").select(text("ts"), *nums("mkt", "mkt_vol"), "high_vol")


ST = f"""s AS (SELECT *, CASE WHEN close < 102 THEN 0 WHEN close < 106 THEN 1 ELSE 2 END AS st, {roll("stddev_samp", "lr", 20, 10)} * sqrt(252) AS rv, close / ({roll("max", "close", 60, 2)}) - 1 AS dd FROM nb)"""


def states(spark, d):
    def add(x, a):
        x = x.withColumns(vol.base_returns(a))
        own = Frames({"_std": Frame("std_samp", "log_return", 20, 10)}, {"rv_close_20": F.col("_std") * F.sqrt(F.lit(252.0)), "ret": F.col("simple_return")})
        return with_frames(x, a, own, vol.drawdown_from_peak())

    df = windowed(b.bars(spark, d), add, lookback=61)
    return df.withColumn("st", F.when(F.col("close") < 102, 0).when(F.col("close") < 106, 1).otherwise(2))


@query("state_statistics", "A7 R8", with_ctes("bars nb", ST + f""", g AS (SELECT symbol, st, avg(lr) AS mr, avg(rv) AS mv, avg(dd) AS md, count(*) AS n FROM s GROUP BY symbol, st)
 SELECT symbol, st, {qnum("mr", "mean_return", 8)}, {qnum("mv", "mean_vol")}, {qnum("md", "mean_drawdown")}, n AS rows, ['calm', 'neutral', 'stress'][row_number() OVER (PARTITION BY symbol ORDER BY mv, md DESC, st)] AS regime FROM g"""))
def state_statistics(spark, d):
    s = rg.named_states(rg.state_statistics(states(spark, d), ["symbol"], "st"), ["symbol"], "st")
    return s.select("symbol", "st", num("mean_return", 8).alias("mean_return"), *nums("mean_vol", "mean_drawdown"), "rows", "regime")


@query("regime_transitions", "R10", with_ctes("bars nb", ST + f""", t AS (SELECT *, lag(st) OVER ({P}) AS f FROM s)
 {SEL}, f AS from_regime, st AS to_regime, CASE WHEN st > f THEN 'bullish_turn' ELSE 'bearish_turn' END AS direction FROM t WHERE f IS NOT NULL AND f <> st"""))
def regime_transitions(spark, d):
    return rg.transitions(states(spark, d), "st").select("symbol", text("ts"), "from_regime", "to_regime", "direction")


@query("transition_matrix", "R11", with_ctes("bars nb", ST + f""", t AS (SELECT *, lag(st) OVER ({P}) AS f FROM s), c AS (SELECT symbol, f, st, count(*) AS n FROM t WHERE f IS NOT NULL GROUP BY 1, 2, 3)
 SELECT symbol, f AS from_state, st AS to_state, n, {qnum("n / sum(n) OVER (PARTITION BY symbol, f)", "probability")}, {qnum("sum(n) OVER (PARTITION BY symbol, f) / sum(n) OVER (PARTITION BY symbol)", "occupancy")} FROM c"""))
def transition_matrix(spark, d):
    return rg.transition_matrix(states(spark, d), "st").select("symbol", "from_state", "to_state", "n", *nums("probability", "occupancy"))


@query("regime_performance", "R12", with_ctes("bars nb", ST + f""", c AS (SELECT *, sum(ret) OVER (PARTITION BY symbol, st ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM s WHERE ret IS NOT NULL)
 SELECT symbol, st, count(*) AS n_days, {qnum("avg(ret)", "avg_return", 8)}, {qnum("avg(ret) / (stddev_pop(ret) + 1e-8) * sqrt(252)", "sharpe")}, {qnum("avg(ret) / stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(252)", "sortino")},
 {qnum("avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)", "win_rate")}, {qnum("avg(CASE WHEN ret > 0 THEN ret END)", "mean_win")}, {qnum("avg(CASE WHEN ret < 0 THEN ret END)", "mean_loss")}, {qnum("max(cum) - min(cum)", "max_drawdown")} FROM c GROUP BY symbol, st"""))
def regime_performance(spark, d):
    g = rg.regime_performance(states(spark, d), ["symbol"], "st", "ret")
    return g.select("symbol", "st", "n_days", num("avg_return", 8).alias("avg_return"), *nums("sharpe", "sortino", "win_rate", "mean_win", "mean_loss", "max_drawdown"))


LABELS = "WITH p AS (SELECT label AS y, CASE WHEN vec_id % 3 = 0 THEN label ELSE CAST(vec_id % 5 AS INTEGER) END AS h FROM embeddings), " \
    "s AS (SELECT y AS cls, count(*) AS support, count(*) FILTER (y = h) AS tp FROM p GROUP BY y), q AS (SELECT h AS cls, count(*) AS said FROM p GROUP BY h)"


def labelled(spark, d):
    return b.embeddings(spark, d).select(F.col("label").alias("y"), F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise((F.col("vec_id") % 5).cast("int")).alias("h"))


@query("label_scores", "R13", f"""{LABELS}
 SELECT cls, support, CAST(coalesce(said, 0) AS BIGINT) AS said, {qnum("tp / nullif(said, 0)", "precision")}, {qnum("tp / support", "recall")}, {qnum("2 * tp / (support + coalesce(said, 0))", "f1")} FROM s LEFT JOIN q USING (cls)""")
def label_scores(spark, d):
    return rg.label_scores(labelled(spark, d), "y", "h").select("cls", "support", "said", *nums("precision", "recall", "f1"))


@query("label_confusion", "R13", f"{LABELS} SELECT y AS truth, h AS predicted, count(*) AS n FROM p WHERE y IS NOT NULL AND h IS NOT NULL GROUP BY y, h")
def label_confusion(spark, d):
    return rg.label_confusion(labelled(spark, d), "y", "h")


@query("label_report", "R13", f"""{LABELS}, c AS (SELECT support, tp, tp::DOUBLE / support AS rc, coalesce(tp::DOUBLE / said, 0) AS pr, 2.0::DOUBLE * tp / (support + coalesce(said, 0)) AS f1 FROM s LEFT JOIN q USING (cls))
 SELECT CAST(sum(support) AS BIGINT) AS n, count(*) AS classes, {qnum("sum(tp)::DOUBLE / sum(support)", "accuracy")}, {qnum("sum(pr * support) / sum(support)", "precision_weighted")},
  {qnum("sum(rc * support) / sum(support)", "recall_weighted")}, {qnum("sum(f1 * support) / sum(support)", "f1_weighted")}, {qnum("avg(f1)", "f1_mean")} FROM c""")
def label_report(spark, d):
    return rg.label_report(labelled(spark, d), "y", "h").select("n", "classes", *nums("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_mean"))


@query("detection_delay", "R14 J5", with_ctes("bars nb", ST + f""", p AS (SELECT symbol, rn - 1 AS k, st, CASE WHEN volume > 25 THEN 1 ELSE 0 END AS h, lag(st) OVER ({P}) AS s1, lag(CASE WHEN volume > 25 THEN 1 ELSE 0 END) OVER ({P}) AS h1 FROM s),
 a AS (SELECT symbol, k FROM p WHERE s1 <> st), z AS (SELECT symbol, k FROM p WHERE h1 <> h), m AS (SELECT a.symbol, a.k, min(abs(a.k - z.k)) AS gap FROM a JOIN z USING (symbol) GROUP BY 1, 2)
 SELECT symbol, {qnum("avg(gap)", "delay")} FROM m GROUP BY symbol"""))
def detection_delay(spark, d):
    df = states(spark, d).withColumn("h", (F.col("volume") > 25).cast("int"))
    return rg.detection_delay(df, "st", "h").select("symbol", num("delay").alias("delay"))


@query("weight_entropy", "R24", with_ctes("emb", f"""p AS (SELECT vec_id, list_transform(emb, lambda x: abs(x)::DOUBLE / list_sum(list_transform(emb, lambda y: abs(y)::DOUBLE))) AS p FROM emb)
 SELECT vec_id, {qnum("-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))", "entropy")} FROM p"""))
def weight_entropy(spark, d):
    e = b.embeddings(spark, d)
    return e.select("vec_id", num(rg.entropy(F.transform("emb", lambda x: F.abs(x.cast("double"))))).alias("entropy"))


# --- point processes -------------------------------------------------------------------------

EFLAG = f"""e AS (SELECT *, CASE WHEN abs(lr) >= {roll("quantile_cont({x}, 0.9)", "abs(lr)", 60, 30)} THEN 1 ELSE 0 END AS ev FROM nb)"""


def flagged(spark, d):
    def add(x, a):
        x = framed(x.withColumn("abs_return", vol.base_returns(a)["abs_return"]), {"_q": Frame("quantile", "abs_return", 60, 30, 0.9)}, a)
        return x.withColumn("ev", F.coalesce((F.col("abs_return") >= F.col("_q")), F.lit(False)).cast("int"))

    return windowed(b.bars(spark, d).select("symbol", "ts", "open", "close"), add, lookback=61).select("symbol", "ts", "ev")


@query("discrete_intensity", "H1 scan", with_ctes("bars nb", EFLAG + f""", r AS (SELECT symbol, rn, ts, 0.8::DOUBLE * ev AS lam FROM e WHERE rn = 1 UNION ALL SELECT e.symbol, e.rn, e.ts, exp(-0.2::DOUBLE) * r.lam + 0.8::DOUBLE * e.ev FROM r JOIN e ON e.symbol = r.symbol AND e.rn = r.rn + 1)
 {SEL}, {qnum("lam", "intensity")} FROM r"""))
def discrete_intensity(spark, d):
    df = flagged(spark, d).select("symbol", "ts", "ev")
    return hk.discrete_intensity(df, "ev").select("symbol", text("ts"), num("intensity").alias("intensity"))


DGRID = (0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95)
DLL = EFLAG + """, gp AS (SELECT a AS alpha, bb AS beta FROM (SELECT unnest({points}) AS a), (SELECT unnest({points}) AS bb)),
 r AS (SELECT symbol, rn, alpha, beta, 0.01::DOUBLE AS lam, ev, 0.0::DOUBLE AS ll FROM e, gp WHERE rn = 1 UNION ALL
  SELECT symbol, rn, alpha, beta, l, ev, ll + CASE WHEN ev > 0 THEN ln(l) ELSE 0 END - l FROM (SELECT e.symbol, e.rn, r.alpha, r.beta, greatest(0.01::DOUBLE + exp(-r.beta) * (r.lam - 0.01::DOUBLE) + r.alpha * r.ev, 1e-10) AS l, e.ev, r.ll FROM r JOIN e ON e.symbol = r.symbol AND e.rn = r.rn + 1)),
 fl AS (SELECT symbol, alpha, beta, arg_max(ll, rn) AS ll FROM r GROUP BY 1, 2, 3)""".replace("{points}", "[" + ", ".join(f"{x}::DOUBLE" for x in DGRID) + "]")


@query("discrete_likelihood", "H2 J14", with_ctes("bars nb", DLL + f" SELECT symbol, {qnums('alpha', 'beta')}, {qnum('ll', 'log_likelihood', 5)} FROM fl"))
def discrete_likelihood(spark, d):
    pts = [(a, c, 0.01) for a in DGRID for c in DGRID]
    ll = hk.discrete_likelihood(flagged(spark, d), "ev", pts)
    return ll.select("symbol", *nums("alpha", "beta"), num("log_likelihood", 5).alias("log_likelihood"))


@query("discrete_estimate", "H3", with_ctes("bars nb", DLL + f" SELECT symbol, {qnum('arg_max(alpha, ll)', 'alpha')}, {qnum('arg_max(beta, ll)', 'beta')}, {qnum('max(ll)', 'log_likelihood', 5)} FROM fl GROUP BY symbol"))
def discrete_estimate(spark, d):
    g = hk.estimate_discrete(flagged(spark, d), "ev", DGRID, DGRID)
    return g.select("symbol", *nums("alpha", "beta"), num("log_likelihood", 5).alias("log_likelihood"))


CLL = EFLAG + """, sp AS (SELECT symbol, min(ts) AS t0, greatest(max(ts) - min(ts), 1)::DOUBLE AS hz, sum(ev)::DOUBLE AS n FROM e GROUP BY symbol),
 tt AS (SELECT e.symbol, (ts - t0)::DOUBLE AS t, hz, n, row_number() OVER (PARTITION BY e.symbol ORDER BY ts) AS k FROM e JOIN sp USING (symbol) WHERE ev = 1),
 gp AS (SELECT ms, a, bb FROM (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS ms), (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.8]) AS a), (SELECT unnest([0.05::DOUBLE, 0.2, 0.5, 1.5]) AS bb)),
 r AS (SELECT symbol, k, t, hz, n, ms, a, bb, 1.0::DOUBLE AS exc, a * (1 - exp(-bb * (hz - t))) - ln(ms * greatest(n / hz, 1e-6)) AS s FROM tt, gp WHERE k = 1 UNION ALL
  SELECT symbol, k, t, hz, n, ms, a, bb, x + 1, s + a * (1 - exp(-bb * (hz - t))) - ln(ms * greatest(n / hz, 1e-6) + a * bb * x) FROM
   (SELECT tt.symbol, tt.k, tt.t, tt.hz, tt.n, r.ms, r.a, r.bb, r.exc * exp(-r.bb * (tt.t - r.t)) AS x, r.s FROM r JOIN tt ON tt.symbol = r.symbol AND tt.k = r.k + 1)),
 nl AS (SELECT symbol, ms, a, bb, ms * greatest(max(n) / max(hz), 1e-6) AS mu, arg_max(s, k) + ms * greatest(max(n) / max(hz), 1e-6) * max(hz) AS nll, max(n) AS n, max(hz) AS hz FROM r GROUP BY symbol, ms, a, bb),
 ft AS (SELECT symbol, arg_min(mu, nll) AS mu, arg_min(a, nll) AS alpha, arg_min(bb, nll) AS beta, min(nll) AS nll, max(n) AS n, max(hz) AS hz FROM nl GROUP BY symbol)"""
GRID = ((0.25, 0.5, 0.75, 1.0), (0.1, 0.3, 0.5, 0.8), (0.05, 0.2, 0.5, 1.5))


@query("exponential_likelihood", "H4 J14", with_ctes("bars nb", CLL + f" SELECT symbol, {qnum('mu', 'mu')}, {qnum('a', 'alpha')}, {qnum('bb', 'beta')}, {qnum('nll', 'nll', 5)} FROM nl"))
def exponential_likelihood(spark, d):
    ev = hk.event_times(flagged(spark, d), "ev")
    return hk.exponential_likelihood(ev, *GRID).select("symbol", *nums("mu", "alpha", "beta"), num("nll", 5).alias("nll"))


@query("exponential_fit", "H5 P25", with_ctes("bars nb", CLL + f" SELECT symbol, {qnums('mu', 'alpha', 'beta')}, {qnum('nll', 'nll', 5)}, CAST(n AS BIGINT) AS n_events, {qnum('hz', 'horizon')}, true AS success FROM ft"))
def exponential_fit(spark, d):
    f = hk.fit_grid(hk.event_times(flagged(spark, d), "ev"), *GRID)
    return f.select("symbol", *nums("mu", "alpha", "beta"), num("nll", 5).alias("nll"), F.col("n_events").cast("long").alias("n_events"), num("horizon").alias("horizon"), "success")


@query("intensity_on_bars", "H6", with_ctes("bars nb", EFLAG + f""", sp AS (SELECT symbol, greatest(max(ts) - min(ts), 1)::DOUBLE AS hz, sum(ev)::DOUBLE AS n FROM e GROUP BY symbol),
 x AS (SELECT a.symbol, a.ts, sum(CASE WHEN b.ev = 1 AND b.ts < a.ts THEN exp(-0.05::DOUBLE * (a.ts - b.ts)) ELSE 0 END) AS exc FROM e a JOIN e b ON b.symbol = a.symbol AND b.ts <= a.ts GROUP BY a.symbol, a.ts)
 {SEL}, {qnum("n / hz * 0.7::DOUBLE + 0.25::DOUBLE * 0.05::DOUBLE * exc", "hawkes_intensity")}, {qnum("n / hz", "poisson_intensity")}, {qnum("(n / hz * 0.7::DOUBLE + 0.25::DOUBLE * 0.05::DOUBLE * exc) / (n / hz)", "cluster_ratio")} FROM x JOIN sp USING (symbol)"""))
def intensity_on_bars(spark, d):
    df = flagged(spark, d)
    params = hk.event_times(df, "ev").select("symbol", "n_events", "horizon").distinct().select(
        "symbol", "n_events", "horizon", (F.col("n_events") / F.col("horizon") * 0.7).alias("mu"), F.lit(0.25).alias("alpha"), F.lit(0.05).alias("beta"))
    return hk.intensity_on_bars(df, "ev", params, checked(b.bars(spark, d))).select("symbol", text("ts"), *nums("hawkes_intensity", "poisson_intensity", "cluster_ratio"))


BIV = EVT.replace("* 86400 AS DOUBLE", "AS DOUBLE") + """, hz AS (SELECT symbol, (max(ts) - min(ts))::DOUBLE AS h FROM nb GROUP BY symbol),
 ex AS (SELECT a.symbol, a.t, a.kind, sum(CASE WHEN b.kind = 0 AND b.t < a.t THEN exp(-0.1::DOUBLE * (a.t - b.t)) ELSE 0 END) AS s0, sum(CASE WHEN b.kind = 1 AND b.t < a.t THEN exp(-0.1::DOUBLE * (a.t - b.t)) ELSE 0 END) AS s1 FROM evt a JOIN evt b ON b.symbol = a.symbol AND b.t <= a.t GROUP BY 1, 2, 3),
 st AS (SELECT symbol, h, greatest(count(*) FILTER (kind = 0) / h, 1e-6) AS mu0, greatest(count(*) FILTER (kind = 1) / h, 1e-6) AS mu1, CASE WHEN count(*) FILTER (kind = 0) > 0 THEN 0.1::DOUBLE ELSE 0 END AS a00, 0.1::DOUBLE AS a01, 0.1::DOUBLE AS a10, CASE WHEN count(*) FILTER (kind = 1) > 0 THEN 0.1::DOUBLE ELSE 0 END AS a11 FROM evt JOIN hz USING (symbol) GROUP BY symbol, h),
 q AS (SELECT ex.*, h, CASE WHEN kind = 0 THEN mu0 ELSE mu1 END AS mu, CASE WHEN kind = 0 THEN a00 ELSE a10 END * s0 AS p0, CASE WHEN kind = 0 THEN a01 ELSE a11 END * s1 AS p1, 1 - exp(-0.1::DOUBLE * (h - t)) AS fd,
   CASE WHEN kind = 0 THEN a00 + a10 ELSE a01 + a11 END AS ao, mu0, mu1 FROM ex JOIN st USING (symbol))"""


def bivariate_inputs(spark, d):
    bars = b.bars(spark, d)
    ev = rg.sigma_events(bars, 1.5).withColumn("t", F.col("t") / 86400)
    hz = bars.groupBy("symbol").agg(F.date_diff(F.max("ts"), F.min("ts")).cast("double").alias("horizon"))
    return ev, hz


@query("bivariate_likelihood", "H8", with_ctes("bars nb", BIV + f" SELECT symbol, {qnum('sum(ln(mu + p0 + p1)) - sum(ao / 0.1::DOUBLE * fd) - (max(mu0) + max(mu1)) * max(h)', 'log_likelihood', 5)} FROM q GROUP BY symbol"))
def bivariate_likelihood(spark, d):
    ev, hz = bivariate_inputs(spark, d)
    ll = hk.bivariate_likelihood(hk._excitations(ev, 0.1, ["symbol"]), hk.bivariate_start(ev, hz), 0.1)
    return ll.select("symbol", num("log_likelihood", 5).alias("log_likelihood"))


@query("bivariate_em_step", "H9", with_ctes("bars nb", BIV + f""" SELECT symbol, {qnum("greatest(sum(CASE WHEN kind = 0 THEN mu / (mu + p0 + p1) ELSE 0 END) / max(h), 1e-8)", "mu0")}, {qnum("greatest(sum(CASE WHEN kind = 1 THEN mu / (mu + p0 + p1) ELSE 0 END) / max(h), 1e-8)", "mu1")},
 {", ".join(qnum(f"CASE WHEN sum(CASE WHEN kind = {j} THEN fd ELSE 0 END) > 0 THEN least(0.1::DOUBLE * sum(CASE WHEN kind = {i} THEN p{j} / (mu + p0 + p1) ELSE 0 END) / sum(CASE WHEN kind = {j} THEN fd ELSE 0 END), 0.095::DOUBLE) ELSE 0 END", f"a{i}{j}") for i in (0, 1) for j in (0, 1))} FROM q GROUP BY symbol"""))
def bivariate_em_step(spark, d):
    ev, hz = bivariate_inputs(spark, d)
    p = hk.em_step(hk._excitations(ev, 0.1, ["symbol"]), hk.bivariate_start(ev, hz), 0.1)
    return p.select("symbol", *nums(*hk.PARAMS))


def _em_rounds(rounds: int) -> str:
    """``fit``: the parameters after so many steps over the decayed counts; ``lk``: the events at those parameters."""
    on = lambda k, v: f"sum(CASE WHEN kind = {k} THEN {v} ELSE 0 END)"
    back = lambda k: f"greatest({on(k, f'mu{k} / lam')} / max(h), 1e-8::DOUBLE)"
    trig = lambda i, j: f"CASE WHEN {on(j, 'fd')} > 0 THEN least(0.1::DOUBLE * {on(i, f'a{i}{j} * s{j} / lam')} / {on(j, 'fd')}, 0.095::DOUBLE) ELSE 0 END"
    own = "CASE WHEN kind = 0 THEN mu0 + a00 * s0 + a01 * s1 ELSE mu1 + a10 * s0 + a11 * s1 END"
    return f"""f0 AS MATERIALIZED (SELECT ex.symbol, kind, s0, s1, h, 1 - exp(-0.1::DOUBLE * (h - t)) AS fd FROM ex JOIN hz USING (symbol)),
 em AS (SELECT symbol, 0 AS i, mu0::DOUBLE AS mu0, mu1::DOUBLE AS mu1, a00::DOUBLE AS a00, a01::DOUBLE AS a01, a10::DOUBLE AS a10, a11::DOUBLE AS a11 FROM st
  UNION ALL SELECT symbol, i + 1, {back(0)}, {back(1)}, {trig(0, 0)}, {trig(0, 1)}, {trig(1, 0)}, {trig(1, 1)}
  FROM (SELECT f0.*, em.* EXCLUDE (symbol), greatest({own}, 1e-12::DOUBLE) AS lam FROM em JOIN f0 USING (symbol) WHERE i < {rounds}) GROUP BY symbol, i),
 fit AS (SELECT * FROM em WHERE i = {rounds}),
 lk AS (SELECT symbol, sum(ln({own})) - sum(CASE WHEN kind = 0 THEN a00 + a10 ELSE a01 + a11 END / 0.1::DOUBLE * fd) - (max(mu0) + max(mu1)) * max(h) AS ll FROM f0 JOIN fit USING (symbol) GROUP BY symbol)"""


@query("bivariate_fit", "H9", with_ctes("bars nb", BIV + ", " + _em_rounds(600) + f""" SELECT symbol, {qnums(*hk.PARAMS, digits=5)},
 {qnum("(a00 + a01) / 0.1::DOUBLE", "branching0", 4)}, {qnum("(a10 + a11) / 0.1::DOUBLE", "branching1", 4)}, {qnum("ll", "log_likelihood", 3)}, true AS settled FROM fit JOIN lk USING (symbol)"""))
def bivariate_fit(spark, d):
    ev, hz = bivariate_inputs(spark, d)
    fit = hk.fit_bivariate(ev, hz, 0.1).select("symbol", *nums(*hk.PARAMS, digits=5), *nums("branching0", "branching1", digits=4), num("log_likelihood", 3).alias("log_likelihood"), "settled")
    return fit


@query("bivariate_intensity", "H7", with_ctes("bars nb", BIV + f""", g AS (SELECT symbol, (ts - min(ts) OVER (PARTITION BY symbol))::DOUBLE AS t FROM nb),
 x AS (SELECT g.symbol, g.t, sum(CASE WHEN b.kind = 0 THEN exp(-0.1::DOUBLE * (g.t - b.t)) ELSE 0 END) AS s0, sum(CASE WHEN b.kind = 1 THEN exp(-0.1::DOUBLE * (g.t - b.t)) ELSE 0 END) AS s1 FROM g LEFT JOIN evt b ON b.symbol = g.symbol AND b.t <= g.t GROUP BY 1, 2)
 SELECT x.symbol, {qnum("t", "t")}, {qnum("mu0 + a00 * s0 + a01 * s1", "intensity0")}, {qnum("mu1 + a10 * s0 + a11 * s1", "intensity1")} FROM x JOIN st USING (symbol)"""))
def bivariate_intensity(spark, d):
    from tidemark.operators.crosssection import per_group

    ev, hz = bivariate_inputs(spark, d)
    g = per_group(b.bars(spark, d).select("symbol", "ts"), ["symbol"], {"t0": F.min("ts")})
    g = g.select("symbol", F.date_diff("ts", "t0").cast("double").alias("t"))
    return hk.bivariate_intensity(ev, g, hk.bivariate_start(ev, hz), 0.1).select("symbol", *nums("t", "intensity0", "intensity1"))


# --- fractal and spectral --------------------------------------------------------------------


def fractal_sql(src: str, keys: str) -> str:
    return f"""lw AS (SELECT DISTINCT {keys}, n, unnest(list_distinct(list_transform(range(20), lambda i: CAST(floor(pow(10::DOUBLE, log10(4::DOUBLE) + i * (log10(n // 2) - log10(4::DOUBLE)) / 19) + 1e-9) AS INTEGER)))) AS w FROM {src}),
 sgm AS (SELECT {", ".join(f"s.{k.strip()}" for k in keys.split(","))}, lw.w, s.p // lw.w AS seg, s.p, s.x FROM {src} s JOIN lw USING ({keys}) WHERE lw.w >= 4 AND s.p // lw.w < s.n // lw.w),
 cm AS (SELECT *, sum(x - m) OVER (PARTITION BY {keys}, w, seg ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, avg(x) OVER (PARTITION BY {keys}, w, seg) AS m FROM sgm)),
 sgs AS (SELECT {keys}, w, seg, max(cum) - min(cum) AS r, stddev_samp(x) AS s, count(*) AS k, greatest(regr_syy(x, p) - pow(regr_sxy(x, p), 2) / regr_sxx(x, p), 0) AS res FROM cm GROUP BY {keys}, w, seg),
 pw AS (SELECT {keys}, w, avg(CASE WHEN s > 0 THEN r / s END) AS rs, avg(sqrt(res / k)) AS fl FROM sgs GROUP BY {keys}, w),
 hh AS (SELECT {keys}, CASE WHEN count(CASE WHEN rs > 0 THEN 1 END) >= 2 THEN regr_slope(CASE WHEN rs > 0 THEN ln(rs) END, ln(w)) END AS h1, CASE WHEN count(CASE WHEN fl > 0 THEN 1 END) >= 2 THEN regr_slope(CASE WHEN fl > 0 THEN ln(fl) END, ln(w)) END AS h2 FROM pw GROUP BY {keys})"""


@query("fractal_exponents", "R17 R18 R19", with_ctes("bars", "ps AS (SELECT symbol, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars), " + fractal_sql("ps", "symbol")
 + f" SELECT symbol, {qnum('h1', 'hurst_rs')}, {qnum('h2', 'hurst_dfa')}, {qnum('2 - h1', 'fd_rs')}, {qnum('2 - h2', 'fd_dfa')} FROM hh"))
def fractal_exponents(spark, d):
    return sp.fractal(b.bars(spark, d).select("symbol", "ts", "close"), "close", ["symbol"]).select("symbol", *nums("hurst_rs", "hurst_dfa", "fd_rs", "fd_dfa"))


@query("rolling_fractal", "R20", with_ctes("bars", """p0 AS (SELECT symbol, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS q, count(*) OVER (PARTITION BY symbol) AS tot FROM bars),
 en AS (SELECT symbol, wl, e FROM (SELECT DISTINCT symbol, tot, unnest(range(49, tot, 50)) AS e FROM p0), (SELECT unnest([50, 100]) AS wl) WHERE e >= wl - 1),
 ps AS (SELECT p0.symbol, wl, e, x, q - (e - wl + 1) AS p, wl AS n FROM p0 JOIN en ON en.symbol = p0.symbol AND q <= e AND q > e - wl), """ + fractal_sql("ps", "symbol, wl, e")
 + f" SELECT symbol, wl AS window_len, CAST(e AS BIGINT) AS end_rn, {qnum('h1', 'hurst_rs')}, {qnum('h2', 'hurst_dfa')} FROM hh"))
def rolling_fractal(spark, d):
    f = sp.rolling_fractal(b.bars(spark, d).select("symbol", "ts", "close"), "close", [50, 100], 50)
    return f.select("symbol", F.col("window").alias("window_len"), "end_rn", *nums("hurst_rs", "hurst_dfa"))


@query("magnitude_spectrum", "R21", with_ctes("bars", f"""ps AS (SELECT symbol, close - avg(close) OVER (PARTITION BY symbol) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 f AS (SELECT DISTINCT symbol, n, unnest(range(n // 2)) AS k FROM ps)
 SELECT symbol, CAST(k AS INTEGER) AS k, {qnum("max(k / f.n)", "frequency")}, {qnum("sqrt(pow(sum(x * cos(2 * pi() * ((k * p) % f.n) / f.n)), 2) + pow(sum(x * sin(2 * pi() * ((k * p) % f.n) / f.n)), 2)) * 2 / max(f.n)", "magnitude")} FROM ps JOIN f USING (symbol) GROUP BY symbol, k"""))
def magnitude_spectrum(spark, d):
    return sp.magnitude_spectrum(b.bars(spark, d).select("symbol", "ts", "close"), "close", ["symbol"]).select("symbol", "k", *nums("frequency", "magnitude"))


WELCH = """ps AS (SELECT symbol, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 sg AS (SELECT DISTINCT symbol, unnest(range((n - 256) // 128 + 1)) AS seg FROM ps), r AS (SELECT ps.symbol, seg, p - seg * 128 AS j, x - avg(x) OVER (PARTITION BY ps.symbol, seg) AS x FROM ps JOIN sg ON sg.symbol = ps.symbol AND p >= seg * 128 AND p < seg * 128 + 256),
 w AS (SELECT *, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 256)) AS y FROM r), tr AS (SELECT i, cos(2 * pi() * i / 256) AS c, sin(2 * pi() * i / 256) AS s FROM (SELECT unnest(range(256)) AS i)),
 ft AS (SELECT symbol, seg, k, pow(sum(y * c), 2) + pow(sum(y * s), 2) AS pw FROM w, (SELECT unnest(range(129)) AS k), tr WHERE tr.i = (k * j) % 256 GROUP BY 1, 2, 3),
 nm AS (SELECT sum(pow(0.5::DOUBLE - 0.5::DOUBLE * c, 2)) AS nw FROM tr), pd AS (SELECT symbol, k, avg(pw / nw * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END) AS psd FROM ft, nm GROUP BY 1, 2)"""


@query("welch_density", "R22", with_ctes("bars", WELCH + f" SELECT symbol, CAST(k AS INTEGER) AS k, {qnum('k / 256', 'frequency')}, {qnum('psd', 'psd')} FROM pd"))
def welch_density(spark, d):
    return sp.welch(b.bars(spark, d).select("symbol", "ts", "close"), "close", ["symbol"]).select("symbol", "k", *nums("frequency", "psd"))


@query("spectral_features", "R23", with_ctes("bars", WELCH + f""", t AS (SELECT *, psd / sum(psd) OVER (PARTITION BY symbol) AS sh FROM pd)
 SELECT symbol, {qnum("sum(CASE WHEN sh > 0 THEN -sh * ln(sh) END)", "spectral_entropy")}, {qnum("arg_max(k, psd) / 256", "dominant_frequency")}, {qnum("max(psd) / sum(psd)", "peak_ratio")}, {qnum("avg(psd)", "psd_mean")}, {qnum("max(psd)", "psd_max")} FROM t GROUP BY symbol"""))
def spectral_features(spark, d):
    f = sp.spectral_features(b.bars(spark, d).select("symbol", "ts", "close"), "close", ["symbol"])
    return f.select("symbol", *nums("spectral_entropy", "dominant_frequency", "peak_ratio", "psd_mean", "psd_max"))
