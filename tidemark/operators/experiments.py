"""Fan-out experiments: grids, folds, walk-forward, Monte Carlo, stress windows, comparisons.

Parameters travel as literal arrays that each row explodes, never as a joined table: the fan-out is a
narrow map, and the plan has one branch however many parameter points there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, finite, ratio
from tidemark.functions.noise import normal, uniform
from tidemark.operators.backtest import compound, target_backtest
from tidemark.operators.crosssection import per_group, quantile_bins
from tidemark.operators.metrics import compact_stats, curve_metrics, curve_ratios
from tidemark.operators.portfolio import capped, exposure, shares, tilt
from tidemark.operators.series import BARS, Axis, checked, has_hot_key, machines, pct_change, positions, prev, roll_mean, roll_std, running, spread, windowed
from tidemark.operators.simulations import Grid, Simulation
from tidemark.operators.tables import last_rows, with_group_size


def structs(rows: Sequence[Mapping]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def fan_out(df: DataFrame, rows: Sequence[Mapping], names: Sequence[str] | None = None) -> DataFrame:
    """Each row once per parameter point."""
    names = list(names or rows[0])
    return df.withColumn("_p", F.explode(structs(rows))).withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")


def grid(**values: Sequence) -> list[dict]:
    return [dict(zip(values, combo)) for combo in product(*values.values())]


# --- grid search -----------------------------------------------------------------------------


def sma_grid_curves(df: DataFrame, points: Sequence[Mapping], axis: Axis, cost_bps: float = 5.0) -> DataFrame:
    """Equity of the SMA-cross rule per (series, fast, slow): one window per distinct length, then the fan-out."""
    lengths = sorted({p[k] for p in points for k in ("fast", "slow")})
    df = windowed(df, lambda d, a: d.withColumns({f"_m{n}": roll_mean("close", a, n) for n in lengths}), axis, lookback=max(lengths))
    entries = F.array(*[
        F.struct(F.lit(p["fast"]).alias("fast"), F.lit(p["slow"]).alias("slow"),
                 F.coalesce((F.col(f"_m{p['fast']}") > F.col(f"_m{p['slow']}")).cast("double"), F.lit(0.0)).alias("signal"))
        for p in points
    ])
    out = df.select(*axis.keys, *axis.order, "close", F.explode(entries).alias("_e")).select(*axis.keys, *axis.order, "close", "_e.*")
    point_axis = axis.within("fast", "slow")
    return target_backtest(out, point_axis, trade=None, fee_bps=cost_bps, slippage_bps=0.0)


def score_curves(curves: DataFrame, axis: Axis, metric: str = "sharpe") -> DataFrame:
    return curve_metrics(curves, axis.within("fast", "slow")).withColumn("score", F.col(metric))


def grid_scores(df: DataFrame, points: Sequence[Mapping], axis: Axis, cost_bps: float = 5.0, metric: str = "sharpe") -> DataFrame:
    """``score_curves`` of ``sma_grid_curves``: the curves of all points of a series are one matrix, unless a series is larger than a task."""
    if has_hot_key(df, axis):
        return score_curves(sma_grid_curves(df, points, axis, cost_bps), axis, metric)
    return curve_ratios(Grid(df, points, axis, cost_bps).curves()).withColumn("score", F.col(metric))


def _best(params: Sequence[str], among: Column | None = None) -> Column:
    """Parameters and score of the best row (``among`` the rows where it holds); the smallest parameters win a tie."""
    rank = F.struct("score", *[-F.col(p) for p in params])
    return F.max_by(F.struct(*params, "score"), rank if among is None else F.when(among, rank))


def best_point(scores: DataFrame, by: Sequence[str], params: Sequence[str] = ("fast", "slow")) -> DataFrame:
    """Parameters of the best score; the smallest parameters win a tie."""
    return scores.groupBy(*by).agg(_best(params).alias("_b")).select(*by, *[F.col(f"_b.{p}").alias(p) for p in params], F.col("_b.score").alias("score"))


def heat_map(scores: DataFrame, by: Sequence[str], row: str, column: str, values: Sequence) -> DataFrame:
    return scores.groupBy(*by, row).pivot(column, list(values)).agg(F.avg("score"))


# --- folds -----------------------------------------------------------------------------------


#: copies of a row that folds and the points tried on them make, roughly; it only sets the size of tasks
FOLD_FAN = 16


def _in_folds(df: DataFrame, folds: Column) -> DataFrame:
    """Explode rows into the (fold, role) slices that contain their position ``rn``."""
    member = F.filter(folds, lambda f: (F.col("rn") >= f["lo"]) & (F.col("rn") < f["hi"]))
    return df.withColumn("_f", F.explode(member)).withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_f")


def _slice(fold, role: str, lo, hi) -> Column:
    as_col = lambda v: v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long")
    return F.struct(as_col(fold).alias("fold"), F.lit(role).alias("role"), as_col(lo).alias("lo"), as_col(hi).alias("hi"))


def expanding_folds(df: DataFrame, splits: int = 5, axis: Axis = BARS, min_train: int = 100, min_test: int = 20) -> DataFrame:
    """n+1 equal blocks: block i+1 tests what all blocks up to i trained."""
    df = with_group_size(positions(spread(df, axis, FOLD_FAN), axis), list(axis.keys), "n")
    size = F.floor(F.col("n") / (splits + 1))
    slices = []
    for i in range(splits):
        edge, end = size * (i + 1), F.least(size * (i + 2), F.col("n"))
        ok = (edge >= min_train) & (end - edge >= min_test)
        slices += [F.when(ok, _slice(i + 1, "train", 0, edge)), F.when(ok, _slice(i + 1, "test", edge, end))]
    return _in_folds(df, F.array_compact(F.array(*slices)))


def walk_forward_folds(df: DataFrame, train: int, test: int, min_train: int, purge: int = 0, embargo: int = 0, mode: str = "rolling",
                       overlap: float = 0.5, axis: Axis = BARS) -> DataFrame:
    """Rolling, expanding or hybrid training windows with a purge gap and an embargo between folds."""
    df = with_group_size(positions(spread(df, axis, FOLD_FAN), axis), list(axis.keys), "n")
    stride = test + purge + embargo
    count = F.floor((F.col("n") - test - min_train) / stride) + 1

    def one(k):
        edge = min_train + k * stride
        start = edge + purge
        rolled = F.greatest(edge - train, F.lit(0))
        lo = F.lit(0) if mode == "expanding" else (F.floor(rolled * (1 - min(overlap, 1.0))) if mode == "hybrid" else rolled)
        return F.array(_slice(k + 1, "train", lo, edge), _slice(k + 1, "test", start, F.least(start + test, F.col("n"))))

    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0))), one))
    usable = F.filter(every, lambda f: (f["role"] == "test") | (f["hi"] - f["lo"] >= min_train))
    return _in_folds(df.where(count >= 1), usable)


def k_folds(df: DataFrame, k: int = 5, purge: int = 5, axis: Axis = BARS, min_train: int = 50) -> DataFrame:
    """k consecutive test blocks; a block counts only if at least ``min_train`` rows precede its purge gap."""
    df = with_group_size(positions(df, axis), list(axis.keys), "n")
    size = F.floor(F.col("n") / k)
    fold = F.floor(F.col("rn") / F.greatest(size, F.lit(1)))
    ready = (fold < k) & (fold * size - purge >= min_train)
    return df.withColumn("fold", (fold + 1).cast("long")).where(ready)


def optimise_folds(folded: DataFrame, points: Sequence[Mapping], axis: Axis = BARS, cost_bps: float = 5.0) -> DataFrame:
    """Per series and fold: the best training point and its test metrics.

    Signals are computed inside each slice, as a strategy that only sees the slice would do. One pass over the rows of a slice
    scores every point on it; one grouping of the scores picks the best training point of a fold and looks up its test metrics.
    """
    sliced, by, params = axis.within("fold", "role"), [*axis.keys, "fold"], ["fast", "slow"]
    scores = grid_scores(folded, points, sliced, cost_bps).dropna(subset=by)
    test = F.struct(*params, F.col("sharpe").alias("test_sharpe"), F.col("total_return_pct").alias("test_return_pct"), F.col("max_drawdown_pct").alias("test_max_dd_pct"))
    role = F.col("role")
    picked = scores.groupBy(*by).agg(_best(params, role == "train").alias("_b"), F.collect_list(F.when(role == "test", test)).alias("_t"))  # one row per point
    picked = picked.withColumn("_t", F.explode(F.filter("_t", lambda t: (t["fast"] == F.col("_b.fast")) & (t["slow"] == F.col("_b.slow")))))
    return picked.select(*by, *[F.col(f"_b.{p}").alias(p) for p in params], F.col("_b.score").alias("train_sharpe"), "_t.test_sharpe", "_t.test_return_pct", "_t.test_max_dd_pct")


def fold_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum of metrics over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return results.groupBy(*by).agg(*aggs)


# --- simulations -----------------------------------------------------------------------------


def monte_carlo(df: DataFrame, signal: str, sims: int, noise_bps: float = 5.0, delays: tuple[int, int] = (0, 3), seed: int = 42,
                cost_bps: float = 5.0, axis: Axis = BARS) -> DataFrame:
    """Equity paths under signal noise and a per-path delay: (keys, ts, sim, equity), a row per path and row. ``simulation`` is what bands and metrics are taken from."""
    lo, hi = delays
    axis = checked(df, axis)
    df = positions(spread(df, axis, sims), axis)
    df = windowed(df, lambda d, a: d.withColumns({f"_d{k}": F.lag(signal, k, 0.0).over(a.spec()) for k in range(lo, hi + 1)}), axis, lookback=hi)
    keep = [*axis.keys, *axis.order, "rn", "close", *[f"_d{k}" for k in range(lo, hi + 1)]]
    paths = df.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    delay = lo + F.floor(uniform(seed, "sim", salt="delay") * (hi - lo + 1)).cast("int")
    paths = paths.withColumn("_delay", delay)
    base = F.lit(0.0)
    for k in range(lo, hi + 1):
        base = F.when(F.col("_delay") == k, F.col(f"_d{k}")).otherwise(base)
    source = F.col("rn") - F.col("_delay")
    shaken = clip(base + normal(seed, *axis.keys, "sim", source) * (noise_bps / 10_000), -1.0, 1.0)
    paths = paths.withColumn("signal", F.when(source >= 0, shaken).otherwise(0.0))
    paths = paths.select(*axis.keys, *axis.order, "close", "sim", "signal")
    return target_backtest(paths, axis.within("sim"), trade=None, fee_bps=cost_bps, slippage_bps=0.0)


def simulation(df: DataFrame, signal: str, sims: int, noise_bps: float = 5.0, delays: tuple[int, int] = (0, 3), seed: int = 42, cost_bps: float = 5.0, axis: Axis = BARS) -> Simulation | DataFrame:
    """The paths of ``monte_carlo``, on arrays inside the tasks; as rows, if a series is larger than a task."""
    axis = checked(df, axis)
    if axis.hot:
        return monte_carlo(df, signal, sims, noise_bps, delays, seed, cost_bps, axis)
    return Simulation(df, signal, sims, noise_bps, delays, seed, cost_bps, axis)


def percentile_bands(paths: Simulation | DataFrame, by: Sequence[str], value: str = "equity", qs: Sequence[int] = (5, 25, 50, 75, 95)) -> DataFrame:
    """Percentiles of all paths per group; of a simulation, the groups are its keys and times."""
    if isinstance(paths, Simulation):
        return paths.bands(qs).select(*by, *[f"p{x}" for x in qs])
    q = paths.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(x / 100) for x in qs])).alias("_q"))
    return q.select(*by, *[F.col("_q")[i].alias(f"p{x}") for i, x in enumerate(qs)])


def permuted_path(df: DataFrame, ret: str, seed: int = 999, axis: Axis = BARS) -> DataFrame:
    """The series' returns in hashed order, rebuilt to a price path from the first close."""
    df = positions(df, axis)
    slots = df.where("rn > 0").select(*axis.keys, (F.col("rn") - 1).alias("slot"), *axis.order)
    drawn = df.where("rn > 0").select(*axis.keys, F.col(ret).alias("shuffled"), (uniform(seed, *axis.keys, "rn") * 1e9).alias("_h"))
    drawn = positions(drawn, Axis(axis.keys, ("_h",), hot=axis.hot), "slot").drop("_h")
    joined = slots.join(drawn, [*axis.keys, "slot"])
    first = df.where("rn = 0").select(*axis.keys, F.col("close").alias("_c0"))
    out = running(joined.join(first, list(axis.keys)), {"_g": ("sum", compound("shuffled"))}, axis)
    return out.withColumn("close", F.col("_c0") * F.exp("_g")).drop("_g", "_c0")


# fixed values: named market-stress windows (name, first day, last day)
STRESS_WINDOWS = (
    ("covid_crash", "2020-02-19", "2020-03-23"),
    ("covid_full", "2020-01-01", "2020-06-30"),
    ("financial_crisis", "2008-09-01", "2009-03-09"),
    ("bear_market_2022", "2022-01-03", "2022-10-12"),
    ("flash_crash_2010", "2010-05-06", "2010-05-07"),
    ("volmageddon_2018", "2018-01-26", "2018-02-09"),
    ("taper_tantrum", "2013-05-22", "2013-06-25"),
    ("dotcom_burst", "2000-03-10", "2002-10-09"),
)


def stress_slices(df: DataFrame, windows: Sequence[tuple[str, str, str]] = STRESS_WINDOWS, ts: str = "ts", keys: Sequence[str] = ("symbol",), least: int = 5) -> DataFrame:
    """Rows inside named date windows, labelled ``scenario``; series with fewer than ``least`` rows in one are left out."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("lo"), F.lit(z).cast("date").alias("hi")) for n, a, z in windows])
    inside = F.filter(table, lambda w: F.to_date(ts).between(w["lo"], w["hi"]))
    out = df.withColumn("scenario", F.explode(F.transform(inside, lambda w: w["name"])))
    enough = out.groupBy(*keys, "scenario").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return out.join(enough, [*keys, "scenario"], "left_semi")


def stress_report(df: DataFrame, bench: DataFrame, by: str, windows: Sequence[tuple[str, str, str]] = STRESS_WINDOWS, key: str = "symbol", ts: str = "ts", price: str = "close",
                  least: int = 5) -> DataFrame:
    """Return, drawdown and Sharpe of each series per stress window, next to its group's benchmark in the same window.

    ``bench`` holds one series per value of ``by``. A benchmark with fewer than ``least`` rows in a window leaves its columns null.
    """
    names = ["total_return_pct", "max_drawdown_pct", "sharpe"]
    own = curve_metrics(stress_slices(df, windows, ts, (by, key), least), Axis((by, key, "scenario"), (ts,)), price)
    of = curve_metrics(stress_slices(bench, windows, ts, (by,), least), Axis((by, "scenario"), (ts,)), price)
    of = of.select(by, "scenario", *[F.col(c).alias(f"bench_{c}") for c in names])
    return own.select(by, key, "scenario", *names).join(of, [by, "scenario"], "left").withColumn("excess_return_pct", F.col("total_return_pct") - F.col("bench_total_return_pct"))


def simulation_summary(paths: Simulation | DataFrame, held: DataFrame, axis: Axis = BARS, equity: str = "equity") -> DataFrame:
    """Per series over its simulated paths: returns, worst drawdown, mean Sharpe, and how many lose or beat holding the asset.

    ``held`` gives the return of holding (``hold_return_pct``), one row per series.
    """
    m = curve_ratios(paths.curves()) if isinstance(paths, Simulation) else curve_metrics(paths, axis.within("sim"), equity)
    m = m.join(held, list(axis.keys), "left")
    r = F.col("total_return_pct")
    return m.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("paths"), F.avg(r).alias("mean_return_pct"), F.stddev_samp(r).alias("std_return_pct"), F.min(r).alias("worst_return_pct"), F.max(r).alias("best_return_pct"),
        F.min("max_drawdown_pct").alias("worst_drawdown_pct"), F.avg("sharpe").alias("mean_sharpe"), F.max("hold_return_pct").alias("hold_return_pct"),
        F.avg((r < 0).cast("double")).alias("losing_share"), F.avg((r > F.col("hold_return_pct")).cast("double")).alias("beating_share"))


# --- overlay and candidate grids -------------------------------------------------------------


def overlay_grid(df: DataFrame, signals: Sequence[str], base: str, ret: str, trend: str, ks: Sequence[float], ups: Sequence[float], downs: Sequence[float], ts: str = "ts") -> DataFrame:
    """Daily returns per (signal, k, up, down): tilted weights per (signal, k), exposure on the date level."""
    points = [{"signal_name": s, "k": float(k)} for s in signals for k in ks]
    entries = F.array(*[F.struct(F.lit(p["signal_name"]).alias("signal_name"), F.lit(p["k"]).alias("k"), F.col(p["signal_name"]).alias("alpha")) for p in points])
    long = df.select(ts, "symbol", base, ret, trend, F.explode(entries).alias("_e")).select(ts, "symbol", base, ret, trend, "_e.*")
    by = ["signal_name", "k", ts]
    long = tilt(long, by, "alpha", "_t")
    long = shares(long, by, {"_w": F.greatest(F.col(base) + F.col("k") * F.col("_t"), F.lit(0.0))})
    daily = long.groupBy(*by).agg(F.sum(F.col("_w") * F.coalesce(ret, F.lit(0.0))).alias("base_ret"), F.max(trend).alias("_trend"))
    out = fan_out(daily, grid(up=[float(u) for u in ups], down=[float(x) for x in downs]))
    return out.withColumn("ret", F.when(F.col("_trend") > 0, F.col("up")).otherwise(F.col("down")) * F.col("base_ret")).drop("base_ret", "_trend")


def train_score(stats: DataFrame) -> DataFrame:
    """Rank parameter points by Sharpe + ½·annual return − ¼·volatility of the training part."""
    return stats.withColumn("train_score", F.col("sharpe") + 0.5 * F.col("annual") - 0.25 * F.col("vol"))


def candidate_returns(df: DataFrame, gates: Sequence[str], directions: Sequence[str], base: str, ret: str, mixes: Sequence[float] = (0.0, 0.25, 0.5),
                      caps: Mapping[str, float] | None = None, ts: str = "ts") -> DataFrame:
    """Daily return of every gate × direction × mode × mix candidate."""
    caps = caps or {"ls": 0.08, "long": 0.15}
    entries = F.array(*[F.struct(F.lit(f"{g}|{d}").alias("candidate"), (F.col(g) * F.col(d)).alias("alpha")) for g in gates for d in directions])
    long = df.select(ts, "symbol", base, ret, F.explode(entries).alias("_e")).select(ts, "symbol", base, ret, "_e.*")
    names = []
    for mode, cap in caps.items():
        for mix in mixes:
            name = f"{mode}|mix{mix:.2f}"
            long = capped(long, ["candidate", ts], "alpha", f"_w_{len(names)}", mode, cap, base, mix)
            names.append(name)
    r = F.coalesce(ret, F.lit(0.0))
    daily = long.groupBy("candidate", ts).agg(*[F.sum(F.col(f"_w_{i}") * r).alias(f"_r{i}") for i in range(len(names))])
    flat = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_r{i}").alias("ret")) for i, n in enumerate(names)])
    return daily.select("candidate", ts, F.explode(flat).alias("_e")).select(F.concat_ws("|", "candidate", "_e.variant").alias("candidate"), ts, F.col("_e.ret").alias("ret"))


def rolling_selector(returns: DataFrame, default: str, look: int = 80, start: int = 80, stick: float = 0.15, ts: str = "ts", per_year: float = 252.0) -> DataFrame:
    """Each date hold the candidate with the best trailing Sharpe, keeping the current one if it is within ``stick``.

    ``returns`` is date-level (ts, candidate, ret): one row per date and candidate.
    """
    axis = Axis(("candidate",), (ts,))
    df = positions(returns, axis)
    w = lambda a: a.rows(-look, -1)

    def add(d: DataFrame, a: Axis) -> DataFrame:
        score = ratio(F.avg("ret").over(w(a)), F.stddev_pop("ret").over(w(a))) * per_year**0.5
        return d.withColumn("_score", F.coalesce(finite(score), F.lit(-1e9)))

    df = windowed(df, add, axis, lookback=look)
    days = df.groupBy(ts, "rn").agg(F.array_sort(F.collect_list(F.struct("candidate", "_score", "ret"))).alias("_c"))
    days = days.select(F.lit(0).alias("_all"), ts, "rn", F.transform("_c", lambda c: c["candidate"]).alias("_n"),
                       F.transform("_c", lambda c: c["_score"]).alias("_s"), F.transform("_c", lambda c: c["ret"]).alias("_r"))

    # state 0 is the default before the start, state i the i-th candidate: they have the same order on every date
    of_default, best = F.array_position("_n", default).cast("int"), F.array_max("_s")
    after = F.zip_with(
        F.concat(F.array(F.element_at("_s", of_default)), F.col("_s")), F.concat(F.array(of_default), F.sequence(F.lit(1), F.size("_s"))),
        lambda score, at: F.when(score >= best - stick, at).otherwise(F.array_position("_s", best).cast("int")),
    )
    moves = F.when(F.col("rn") >= start, after).otherwise(F.sequence(F.lit(0), F.size("_s")))
    held = machines(days, {"_at": (moves, 0)}, Axis(("_all",), (ts,), hot=False))  # one row per date
    at = F.when(F.col("rn") >= start, F.col("_at")).otherwise(of_default)
    return held.select(ts, F.element_at("_n", at).alias("pick"), F.element_at("_r", at).alias("ret"))


# --- reports ---------------------------------------------------------------------------------


def excess(metrics: DataFrame, universe: str, strategy: str, benchmark: str, columns: Sequence[str]) -> DataFrame:
    """Metrics next to their universe's benchmark row, with excess columns."""
    w = Window.partitionBy(universe)  # one row per strategy
    of_bench = lambda c: F.max(F.when(F.col(strategy) == benchmark, F.col(c))).over(w)
    return metrics.withColumns({f"excess_{c}": F.col(c) - of_bench(c) for c in columns})


def overfit_verdicts(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spread and gap verdicts of a runs table with columns kind, return_pct, sharpe."""
    pick = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    g = runs.groupBy(*by).agg(
        (F.avg(pick("train", "return_pct")) - F.avg(pick("test", "return_pct"))).alias("gap_return"),
        (F.avg(pick("train", "sharpe")) - F.avg(pick("test", "sharpe"))).alias("gap_sharpe"),
        F.stddev_samp(pick("test", "return_pct")).alias("return_std"), F.stddev_samp(pick("test", "sharpe")).alias("sharpe_std"),
        ((F.avg(pick("test", "return_pct")) - F.avg(pick("random", "return_pct"))) / (F.stddev_samp(pick("random", "return_pct")) + 1e-8)).alias("z_random"),
    )
    return g.withColumns({
        "overfit": (F.abs("gap_return") > 50) | (F.abs("gap_sharpe") > 1.0),
        "unstable": (F.col("return_std") > 20) | (F.col("sharpe_std") > 0.5),
        "random_like": F.abs("z_random") < 1.0,
    })


def forecast_accuracy(df: DataFrame, axis: Axis, actual: str, predicted: str, season: int = 1) -> DataFrame:
    """MASE, sMAPE (percent) and their plain average OWA = ½(MASE + sMAPE/100) per series."""
    df = windowed(df, lambda d, a: d.withColumn("_naive", F.abs(F.col(actual) - prev(actual, a, season))), axis, lookback=season)
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    err = F.when(both, F.abs(F.col(actual) - F.col(predicted)))
    size = F.abs(actual) + F.abs(predicted)
    g = df.where(both).groupBy(*axis.keys).agg(
        ratio(F.avg(err), F.avg("_naive")).alias("mase"), (F.avg(F.when(size > 0, 2 * err / size)) * 100).alias("smape"))
    return g.withColumn("owa", 0.5 * (F.col("mase") + F.col("smape") / 100))


def ticker_split(stats: DataFrame, value: str, key: str = "symbol", test: float = 0.3, strata: int = 3, seed: int = 42) -> DataFrame:
    """Stratified test/train split of keys: quantile strata, hashed order inside, at least one test key each."""
    df = quantile_bins(stats, value, strata, "stratum").withColumn("_h", uniform(seed, key) * 1e9)
    axis = Axis(("stratum",), ("_h",))
    df = with_group_size(positions(df, axis, "_k"), ["stratum"], "_n")
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(test)))
    return df.withColumn("is_test", F.col("_k") < n_test).drop("_h", "_k", "_n")


def half_split(stats: DataFrame, key: str = "symbol", seed: int = 42) -> DataFrame:
    """Plain random half split by a hash of the key."""
    return stats.withColumn("in_first_half", uniform(seed, key) < 0.5)


def worst_case(stats: DataFrame, by: Sequence[str], min_sharpe: float = -0.5) -> DataFrame:
    """Worst names per group and how many lose or would be excluded."""
    s = F.col("sharpe")
    return stats.groupBy(*by).agg(
        F.min_by("symbol", F.struct("total", "symbol")).alias("worst_return_symbol"), F.min("total").alias("worst_return"),
        F.min_by("symbol", F.struct("sharpe", "symbol")).alias("worst_sharpe_symbol"), F.min("sharpe").alias("worst_sharpe"),
        F.count_if(F.col("total") < 0).alias("losing"), F.count_if(s < min_sharpe).alias("excluded"),
    )


def ticker_review(df: DataFrame, bench: DataFrame, by: str, key: str = "symbol", ts: str = "ts", price: str = "close", degrade_excess: float = -5.0, degrade_drawdown: float = -40.0,
                  min_excess: float = -5.0, min_sharpe: float = -0.5, max_drawdown: float = -50.0) -> DataFrame:
    """Per name: metrics, return above its group's benchmark, whether it degrades the portfolio and whether it is kept.

    A name degrades if it trails the benchmark by too much or falls too deep; it is kept if excess, Sharpe and drawdown all hold.
    """
    own = curve_metrics(df, Axis((by, key), (ts,)), price).select(by, key, F.col("total_return_pct").alias("return_pct"), "max_drawdown_pct", "sharpe")
    of = curve_metrics(bench, Axis((by,), (ts,)), price).select(by, F.col("total_return_pct").alias("_bench"))
    j = own.join(of, by, "left").withColumn("excess_return_pct", F.col("return_pct") - F.col("_bench")).drop("_bench")
    excess, fall = F.col("excess_return_pct"), F.col("max_drawdown_pct")
    return j.withColumns({"degrading": (excess < degrade_excess) | (fall < degrade_drawdown), "kept": (excess >= min_excess) & (F.col("sharpe") >= min_sharpe) & (fall >= max_drawdown)})


def degradation_report(review: DataFrame, by: Sequence[str], key: str = "symbol") -> DataFrame:
    """Per group: the deepest drawdown, how many names degrade or go, and the mean return of the degrading ones (none: 0)."""
    return review.groupBy(*by).agg(
        F.min_by(key, F.struct("max_drawdown_pct", key)).alias("worst_drawdown_symbol"), F.min("max_drawdown_pct").alias("worst_drawdown_pct"), F.count(F.lit(1)).alias("names"),
        F.count_if("degrading").alias("degrading"), F.count_if(~F.col("kept")).alias("excluded"),
        F.coalesce(F.avg(F.when(F.col("degrading"), F.col("return_pct"))), F.lit(0.0)).alias("portfolio_impact_pct"))


def composite_score(df: DataFrame, ret: str, last: int = 60, axis: Axis = BARS) -> DataFrame:
    """Per name: mean, deviation, and 0.6·mean + 0.25·momentum + 0.15·quality, the latter two min-max scaled."""
    per = df.groupBy(*axis.keys).agg(F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("sd"))
    mom = last_rows(df, axis, last).groupBy(*axis.keys).agg((F.avg(ret) * 252.0**0.5).alias("mom"))
    s = per.join(mom, list(axis.keys)).withColumn("q", F.col("mu") / (F.col("sd") + 1e-8))
    edge = s.agg(F.min("mom").alias("_m0"), F.max("mom").alias("_m1"), F.min("q").alias("_q0"), F.max("q").alias("_q1"))
    s = s.join(F.broadcast(edge))  # one row of extremes
    scale = lambda c, lo, hi: (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1e-8)
    s = s.withColumn("composite", 0.6 * F.col("mu") + 0.25 * scale("mom", "_m0", "_m1") + 0.15 * scale("q", "_q0", "_q1"))
    return s.drop("_m0", "_m1", "_q0", "_q1")


def implied_prior(df: DataFrame, weights: DataFrame, value: str, risk: float = 2.5, key: str = "k", at: str = "at") -> DataFrame:
    """Market-implied returns π = λ Σ w.

    Σ w is the covariance of every name with the one weighted portfolio, so no pair of names is formed. On a date without a
    value a name adds nothing to the portfolio's deviation.
    """
    means = df.groupBy(key).agg(F.avg(value).alias("_m"))
    away = df.join(means, key).select(key, at, (F.col(value) - F.col("_m")).alias("_x"))
    portfolio = away.join(weights, key).groupBy(at).agg(F.sum(F.col("w") * F.col("_x")).alias("_p"))
    g = away.join(portfolio, at).groupBy(key).agg(F.sum(F.col("_x") * F.col("_p")).alias("_s"), F.count("_x").alias("_n"))
    return g.where("_n > 1").select(F.col(key).alias("key"), (risk * F.col("_s") / (F.col("_n") - 1)).alias("prior"))


def beta_hedge(df: DataFrame, axis: Axis, ret: str, market: str, n: int = 60, least: int = 20, target: float = 0.2, vol: float = 0.10) -> DataFrame:
    """Lagged rolling-beta split into alpha and beta parts, a beta-target return and a vol-targeted alpha."""
    w = axis.trailing(n)
    beta = F.when(F.count(F.col(ret) + F.col(market)).over(w) >= least, finite(F.covar_samp(ret, market).over(w) / F.nullif(F.var_samp(market).over(w), F.lit(0.0))))
    df = df.withColumn("_b0", beta).withColumn("_b", F.coalesce(prev("_b0", axis), F.lit(0.0)))
    df = df.withColumn("beta_component", F.col("_b") * F.col(market))
    df = df.withColumns({
        "alpha_component": F.col(ret) - F.col("beta_component"),
        "beta_target": F.col(ret) - (F.col("_b") - target) * F.col(market),
    })
    av = roll_std("alpha_component", axis, 20, 10) * 252.0**0.5
    df = df.withColumn("_s", clip(vol / F.nullif(av, F.lit(0.0)), 0.5, 2.0))
    return df.withColumn("alpha_vol_target", F.col("alpha_component") * F.coalesce(prev("_s", axis), F.lit(1.0))).drop("_b0", "_b", "_s")


def intents(df: DataFrame, max_weight: float, min_quantity: float, min_notional: float, long_only: bool = True,
            stop_loss: float | None = None, take_profit: float | None = None) -> DataFrame:
    """Order intents from signal, held quantity, equity and price; small changes are dropped."""
    w = clip("signal", 0.0 if long_only else -1.0, 1.0)
    w = clip(w, -max_weight, max_weight)
    df = df.withColumn("order_quantity", F.col("equity") * w / F.nullif(F.col("close"), F.lit(0.0)) - F.col("quantity"))
    df = df.withColumn("notional", F.abs("order_quantity") * F.col("close"))
    move = F.col("close") / F.col("entry_price") - 1
    rule = F.lit("none")
    if take_profit is not None:
        rule = F.when(move >= take_profit, "take_profit").otherwise(rule)
    if stop_loss is not None:
        rule = F.when(move <= -stop_loss, "stop_loss").otherwise(rule)
    df = df.withColumns({"side": F.when(F.col("order_quantity") > 0, "buy").otherwise("sell"), "exit_rule": rule})
    return df.where((F.abs("order_quantity") >= min_quantity) & (F.col("notional") >= min_notional))


def fills_table(fills: DataFrame) -> DataFrame:
    return fills.withColumns({
        "notional": F.col("qty") * F.col("price"),
        "signed_qty": F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")),
    })
