"""Event flags, regime labels and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import ratio
from tidemark.operators.crosssection import date_axis, digitize, per_group
from tidemark.operators.joins import nearest_join
from tidemark.operators.quantiles import with_quantiles
from tidemark.operators.series import BARS, Axis, checked, log_return, pct_change, positions, prev, roll_std, roll_sum, running, scan, windowed

NAMES = ("calm", "neutral", "stress", "extreme")


def variance_breakouts(df: DataFrame, axis: Axis | None = None, n: int = 20, k: float = 2.0) -> DataFrame:
    """Root of summed squared log returns above its own mean + k deviations; keeps the breakout rows."""
    axis = axis or checked(df)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_lr", log_return("close", a))
        return d.withColumn("rv", F.sqrt(roll_sum(F.col("_lr") * F.col("_lr"), a, n)))

    df = windowed(df, add, axis, lookback=n + 1)
    df = per_group(df, axis.keys, {"_m": F.avg("rv"), "_s": F.stddev_samp("rv")}, axis.hot)
    df = df.withColumn("threshold", F.col("_m") + k * F.col("_s"))
    return df.where(F.col("rv") > F.col("threshold")).drop("_lr", "_m", "_s")


def cusum_breakouts(df: DataFrame, axis: Axis | None = None, drift: float = 0.5, height: float = 5.0) -> DataFrame:
    """Two-sided cumulative sums of log returns with drift; a crossing is an event and restarts both."""
    axis = axis or checked(df)
    df = windowed(df, lambda d, a: d.withColumn("_lr", log_return("close", a)), axis, lookback=1)
    df = per_group(df, axis.keys, {"_sd": F.stddev_samp("_lr")}, axis.hot)

    def step(pdf, state):
        up, down = state if state is not None else (0.0, 0.0)
        x, sd = pdf["_lr"].to_numpy(dtype=float), pdf["_sd"].to_numpy(dtype=float)
        stat, event = np.full(len(x), np.nan), np.zeros(len(x), dtype=bool)
        for i in range(len(x)):
            if np.isnan(x[i]) or not sd[i] > 0:
                continue
            up = max(0.0, up + x[i] - drift * sd[i])
            down = max(0.0, down - x[i] - drift * sd[i])
            stat[i] = max(up, down)
            if stat[i] > height * sd[i]:
                event[i], up, down = True, 0.0, 0.0
        return {"cusum": stat, "cusum_event": event}, [up, down]

    return scan(df, step, "cusum double, cusum_event boolean", axis, needs=["_lr", "_sd"]).drop("_lr", "_sd")


def sigma_events(df: DataFrame, sigma: float = 3.0, axis: Axis | None = None, ts: str = "ts") -> DataFrame:
    """(keys, kind, t): drops (kind 0) and jumps (kind 1) beyond k deviations, seconds since the series start."""
    axis = axis or checked(df)
    df = windowed(df, lambda d, a: d.withColumn("_lr", log_return("close", a)), axis, lookback=1)
    df = per_group(df, axis.keys, {"_sd": F.stddev_pop("_lr"), "_t0": F.min(ts)}, axis.hot)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("_t0").cast("timestamp"))
    kind = F.when(F.col("_lr") < -sigma * F.col("_sd"), 0).when(F.col("_lr") > sigma * F.col("_sd"), 1)
    return df.select(*axis.keys, kind.alias("kind"), seconds.cast("double").alias("t")).where("kind IS NOT NULL").distinct()


def quantile_labels(df: DataFrame, n: int = 3, window: int = 20, axis: Axis | None = None) -> DataFrame:
    """Volatility-quantile regime 0..n-1 per series (``vol_regime``); bars without a volatility get 0."""
    axis = axis or checked(df)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("_lr", log_return("close", a))
        return d.withColumns({"rv": roll_std("_lr", a, window) * F.sqrt(F.lit(252.0)), "ret": pct_change("close", a)})

    df = windowed(df, add, axis, lookback=window + 1)
    cuts = [i / n for i in range(1, n)]
    df = with_quantiles(per_group(df, axis.keys, {"_k": F.count("rv")}, axis.hot), "rv", cuts, axis.keys, "_e", axis.hot)
    label = digitize("rv", [F.col("_e")[i] for i in range(n - 1)])
    label = F.when(F.col("_k") < 3 * n, 0).otherwise(F.coalesce(label, F.lit(0)))
    return df.withColumn("vol_regime", label).drop("_lr", "_e", "_k")


def regime_profile(df: DataFrame, by: Sequence[str], label: str = "vol_regime") -> DataFrame:
    """Mean volatility, mean return and frequency per regime."""
    g = df.groupBy(*by, label).agg(F.avg("rv").alias("mean_vol"), F.avg("ret").alias("mean_return"), F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy(*by))
    name = F.when(F.col(label) == 0, "low_vol").when(F.col(label) == 1, "medium_vol").when(F.col(label) == 2, "high_vol")
    return g.withColumns({"frequency": share, "name": F.coalesce(name, F.concat(F.lit("regime_"), F.col(label).cast("string")))})


def market_regime(df: DataFrame, ret: str, split: float = 0.7, ts: str = "ts", window: int = 20, least: int = 10) -> DataFrame:
    """Date-level high-volatility flag: volatility of the mean return against its training median."""
    daily = df.groupBy(ts).agg(F.avg(ret).alias("mkt"))
    daily = daily.withColumn("_all", F.lit(0))
    axis = date_axis(ts, ["_all"])  # one row per date
    daily = positions(daily, axis).withColumn("mkt_vol", roll_std("mkt", axis, window, least))
    daily = daily.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_all")))
    train = F.when(F.col("rn") < F.floor(F.col("_n") * F.lit(split)), F.col("mkt_vol"))
    daily = daily.withColumn("_t", train).withColumn("_m", F.percentile("_t", F.lit(0.5)).over(Window.partitionBy("_all")))
    return daily.select(ts, "mkt", "mkt_vol", F.coalesce((F.col("mkt_vol") >= F.col("_m")).cast("int"), F.lit(0)).alias("high_vol"))


def state_statistics(df: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    return df.groupBy(*by, state).agg(
        F.avg("log_return").alias("mean_return"), F.avg("rv_close_20").alias("mean_vol"), F.avg("drawdown_60").alias("mean_drawdown"), F.count(F.lit(1)).alias("rows")
    )


def named_states(stats: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Rank states by volatility (then shallower drawdown first) and name them calm, neutral, stress, extreme."""
    w = Window.partitionBy(*by).orderBy("mean_vol", F.desc("mean_drawdown"), state)
    rank = F.row_number().over(w) - 1
    return stats.withColumns({"state_rank": rank, "regime": F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.least(rank, F.lit(len(NAMES) - 1)) + 1)})


def transitions(df: DataFrame, label: str, axis: Axis = BARS) -> DataFrame:
    """Rows where the label changed: from, to, direction."""
    df = windowed(df, lambda d, a: d.withColumn("from_regime", prev(label, a)), axis, lookback=1)
    out = df.where(F.col("from_regime").isNotNull() & (F.col("from_regime") != F.col(label)))
    turn = F.when(F.col(label) > F.col("from_regime"), "bullish_turn").otherwise("bearish_turn")
    return out.select(*axis.keys, *axis.order, "from_regime", F.col(label).alias("to_regime"), turn.alias("direction"))


def transition_matrix(df: DataFrame, label: str, axis: Axis = BARS) -> DataFrame:
    """Empirical transition probabilities, and the occupancy share of the origin state."""
    keys = list(axis.keys)
    df = windowed(df, lambda d, a: d.withColumn("_from", prev(label, a)), axis, lookback=1)
    pairs = df.where("_from IS NOT NULL").groupBy(*keys, F.col("_from").alias("from_state"), F.col(label).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    row, all_rows = Window.partitionBy(*keys, "from_state"), Window.partitionBy(*keys)
    return pairs.withColumns({
        "probability": F.col("n") / F.sum("n").over(row), "occupancy": F.sum("n").over(row) / F.sum("n").over(all_rows),
        "is_persistence": F.col("from_state") == F.col("to_state"),
    })


def regime_performance(df: DataFrame, by: Sequence[str], label: str, ret: str, axis: Axis = BARS) -> DataFrame:
    """Per regime: count, mean, deviation, Sharpe, Sortino, win rate, mean win and loss, drawdown of the summed returns."""
    within = axis.within(label)
    d = running(df.where(F.col(ret).isNotNull()), {"_cum": ("sum", ret)}, within)
    r, root = F.col(ret), 252.0**0.5
    d = d.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("std_return"),
        F.stddev_pop(F.when(r < 0, r)).alias("_d"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r < 0, r)).alias("mean_loss"),
        (F.max("_cum") - F.min("_cum")).alias("max_drawdown"),
    )
    return d.withColumns({
        "sharpe": F.col("avg_return") / (F.col("std_return") + 1e-8) * root, "sortino": ratio("avg_return", "_d") * root,
        "calmar": ratio(F.col("avg_return") * 252, "max_drawdown"),
    }).drop("_d")


def label_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts with precision, recall and F1 of the true class; sums give accuracy and weighted F1."""
    c = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    # the confusion table has one row per pair of classes
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    actual = c.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = c.groupBy(F.col(predicted).alias("cls")).agg(F.sum("n").alias("said"))
    s = actual.join(said, "cls", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("said"))
    return s.withColumns({"precision": ratio("tp", F.col("said").cast("double")), "recall": F.col("tp") / F.col("support"), "f1": f1})


def label_confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per (true, predicted) pair that occurs; rows without one of the two labels do not count."""
    both = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, support-weighted precision, recall and F1, plain mean F1 of the true classes (nothing predicted: precision 0)."""
    both = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    s, n = label_scores(both, truth, predicted), F.sum("support")
    weighted = lambda c: F.sum(F.coalesce(c, F.lit(0.0)) * F.col("support")) / n
    return s.agg(n.alias("n"), F.count(F.lit(1)).alias("classes"), (F.sum("tp") / n).alias("accuracy"), weighted("precision").alias("precision_weighted"),
                 weighted("recall").alias("recall_weighted"), weighted("f1").alias("f1_weighted"), F.avg("f1").alias("f1_mean"))


def detection_delay(df: DataFrame, truth: str, predicted: str, axis: Axis = BARS) -> DataFrame:
    """Mean distance, in rows, from a true change to the nearest predicted change."""
    keys = list(axis.keys)
    df = positions(df, axis)
    df = windowed(df, lambda d, a: d.withColumns({"_pt": prev(truth, a), "_pp": prev(predicted, a)}), axis, lookback=1)
    changed = lambda p, c: F.col(p).isNotNull() & (F.col(p) != F.col(c))
    real = df.where(changed("_pt", truth)).select(*keys, F.timestamp_seconds("rn").alias("at"))
    said = df.where(changed("_pp", predicted)).select(*keys, F.timestamp_seconds("rn").alias("at"), F.lit(1).alias("one"))
    near = nearest_join(real, said, tuple(keys), "at")
    return near.groupBy(*keys).agg(F.coalesce(F.avg("gap_seconds"), F.lit(0.0)).alias("delay"))


def entropy(weights: Column) -> Column:
    """−Σ p ln p of an array normalised to sum 1; zero entries add nothing."""
    total = F.aggregate(weights, F.lit(0.0), lambda t, x: t + x)
    p = F.transform(weights, lambda x: x / F.nullif(total, F.lit(0.0)))
    return F.aggregate(p, F.lit(0.0), lambda t, x: t - F.when(x > 0, x * F.log(x)).otherwise(0.0))
