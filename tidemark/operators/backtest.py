"""Equity curves and back-tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.series import Axis, has_hot_key, running, scan, windowed


def compound(r: Column | str) -> Column:
    """Log growth of a return; summed and exponentiated it gives the running product.

    A missing return counts as 0. A return of -100 % or worse has no logarithm and is an error of the
    data, not of the plan: it is floored just above -1 so that equity goes to (almost) zero and stays.
    """
    r = F.col(r) if isinstance(r, str) else r
    return F.log1p(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(-1 + 1e-12)))


def rebalance_mask(axis, freq: str, day: int | None = None) -> Column:
    """True on rows that may trade: every row, the first row of an ISO week or month, or a given day.

    ``day`` is a weekday (0 = Monday) for weekly and a day of the month for monthly masks. The first
    row of a series always trades. Weeks are keyed by ISO week and calendar year.
    """
    ts = F.col(axis.order[0])
    first = F.lag(ts).over(axis.spec()).isNull()
    if freq == "daily":
        return F.lit(True)
    if day is not None:
        return first | ((F.weekday(ts) if freq == "weekly" else F.dayofmonth(ts)) == day)
    period = F.weekofyear(ts) if freq == "weekly" else F.month(ts)
    code = period * 10000 + F.year(ts)
    return first | (code != F.lag(code).over(axis.spec()))


# --- weight back-test ------------------------------------------------------------------------


def panel_dates(df, by=(), ts: str = "ts"):
    """Dates of each group with their position ``di`` and the following date: one row per group and date."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.select(*by, ts).distinct().select(
        *by, ts, F.row_number().over(w).alias("di"), F.lead(ts).over(w).alias("next_ts")
    )


def weight_backtest(df, columns, by, ret: str = "ret", cost_bps: float = 5.0, days=None, symbol: str = "symbol", ts: str = "ts", half: bool = False):
    """Back-test of several weight columns at once; costs follow the turnover.

    Weights decided on one date of a group earn the group's next date. ``df``: (*by, ts, symbol, ret,
    weight columns). ``days``: ``panel_dates`` of the groups, derived from ``df`` when not given. A name
    without a row on the next date earns 0 and is sold there. Result per (*by, strategy, ts):
    gross_return, cost, return, turnover, gross, net, equity on every date, the first of which holds
    nothing. ``half`` counts one side of each change only.

    Rows meet once per (group, name) for their previous weight and next return; what follows is a
    partially aggregated sum per date. The strategies become rows on the date level only.
    """
    days = panel_dates(df, by, ts) if days is None else days
    placed = df.join(days.drop("next_ts"), [*by, ts])
    axis = Axis((*by, symbol), ("di",), hot=False)  # one row per date
    w = axis.spec()
    here = F.coalesce(F.lead("di").over(w) == F.col("di") + 1, F.lit(False))
    placed = placed.withColumns({"_here": here, "_next": F.when(here, F.coalesce(F.lead(ret).over(w), F.lit(0.0))).otherwise(0.0),
                                 "_seen": F.coalesce(F.lag("di").over(w) == F.col("di") - 1, F.lit(False)),
                                 **{f"_b_{c}": F.lag(c).over(w) for c in columns}})
    nil = F.lit(0.0)
    bought, sold = [(F.col("di") + 1).alias("di")], [(F.col("di") + 2).alias("di")]
    for c in columns:
        before = F.when(F.col("_seen"), F.col(f"_b_{c}")).otherwise(0.0)
        bought += [F.abs(F.col(c) - before).alias(f"t_{c}"), (F.col(c) * F.col("_next")).alias(f"r_{c}"), F.abs(c).alias(f"g_{c}"), F.col(c).alias(f"n_{c}")]
        sold += [F.abs(c).alias(f"t_{c}"), nil.alias(f"r_{c}"), nil.alias(f"g_{c}"), nil.alias(f"n_{c}")]
    moves = F.array_compact(F.array(F.struct(*bought), F.when(~F.col("_here"), F.struct(*sold))))
    flat = placed.select(*by, F.explode(moves).alias("_e")).select(*by, "_e.*")
    sums = flat.groupBy(*by, "di").agg(*[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in columns for k in "trgn"])
    wide = days.drop("next_ts").join(sums, [*by, "di"], "left").fillna(0.0)
    side = 0.5 if half else 1.0
    rows = F.array(*[
        F.struct(F.lit(c).alias("strategy"), F.col(f"r_{c}").alias("gross_return"), (F.col(f"t_{c}") * side).alias("turnover"),
                 F.col(f"g_{c}").alias("gross"), F.col(f"n_{c}").alias("net"))
        for c in columns
    ])
    out = wide.select(*by, ts, F.explode(rows).alias("_e")).select(*by, ts, "_e.*")
    out = out.withColumn("cost", F.col("turnover") * (cost_bps * 1e-4))
    out = out.withColumn("return", F.col("gross_return") - F.col("cost"))
    curve = Axis((*by, "strategy"), (ts,), hot=False)  # one row per date and strategy
    return running(out, {"_g": ("sum", compound("return"))}, curve).withColumn("equity", F.exp("_g")).drop("_g")


# --- single-asset target weights -------------------------------------------------------------


def target_backtest(df, axis, signal: str = "signal", trade: str | None = "trades_now", fee_bps: float = 4.0, slippage_bps: float = 1.0,
                    spread_bps: float = 0.0, cash: float = 10_000.0, tax_rate: float = 0.0):
    """Equity of a target weight held between rebalances, in closed form per segment.

    Between two rebalances equity is E·(1 − c·τ + w·(P/P₀ − 1)) with the target w, the entry price P₀
    and the traded share τ = |w − drifted weight|; E is the running product over segments. The drifted
    weight ignores the cost of the previous trade, an error of second order in the cost rate.
    With ``trade=None`` every row rebalances; then a row is its own segment and nothing is joined.
    """
    c = (fee_bps + slippage_bps + spread_bps) * 1e-4
    p = F.col("close")

    def add(d, a):
        w0, p0 = F.lag(signal).over(a.spec()), F.lag("close").over(a.spec())
        move = p / p0
        drifted = F.coalesce(w0 * move / (1 + w0 * (move - 1)), F.lit(0.0))
        d = d.withColumn("_tau", F.abs(F.col(signal) - drifted))
        grown = 1 - c * F.lag("_tau").over(a.spec()) + w0 * (move - 1)
        return d.withColumn("_grown", F.coalesce(grown, F.lit(1.0)))

    on = [*axis.keys, *axis.order]
    nodes = windowed(df if trade is None else df.where(F.col(trade)), add, axis, lookback=3)
    nodes = running(nodes, {"_log": ("sum", F.log(F.greatest("_grown", F.lit(1e-12))))}, axis)
    node = F.struct(F.exp("_log").alias("e"), F.col(signal).alias("w"), p.alias("p"), F.col("_tau").alias("tau"))
    if trade is None:
        out = _own_nodes(nodes, node, on).drop("_tau", "_grown", "_log")
    else:
        out = df.join(nodes.select(*on, node.alias("_node")), on, "left")
    out = out.withColumn("_traded", F.col("_node.e") * F.col("_node.tau"))
    out = running(out, {"_node": ("last", "_node"), "_volume": ("sum", F.coalesce("_traded", F.lit(0.0)))}, axis)
    n = F.col("_node")
    equity = cash * n["e"] * (1 - c * n["tau"] + n["w"] * (p / n["p"] - 1))
    out = out.withColumns({"equity": F.coalesce(equity, F.lit(cash)), "traded": cash * F.coalesce("_volume", F.lit(0.0))})
    out = out.withColumns({
        "fees": F.col("traded") * (fee_bps * 1e-4), "slippage": F.col("traded") * (slippage_bps * 1e-4), "spread_cost": F.col("traded") * (spread_bps * 1e-4),
        "tax": F.greatest(F.col("equity") - cash, F.lit(0.0)) * tax_rate,
    })
    return out.drop("_node", "_traded", "_volume")


def _own_nodes(nodes, node, on):
    """What joining the nodes to their own rows by ``on`` gives, behind the exchange they have: rows of one key and time meet each other, a null meets nothing."""
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    alike = Window.partitionBy(*on)
    tied = nodes.withColumns({"_own": F.when(known, node), "_many": F.count(F.lit(1)).over(alike) > 1})
    tied = tied.withColumn("_all", F.collect_list(F.when(F.col("_many"), F.col("_own"))).over(alike))
    pairs = F.when(F.col("_many") & known, F.reverse("_all")).otherwise(F.array("_own"))
    return tied.withColumn("_node", F.explode(pairs)).drop("_own", "_many", "_all")


def buy_and_hold(df, axis, cash: float = 1.0):
    """Close relative to the first close of the series."""
    df = running(df, {"_p0": ("first", "close")}, axis)
    return df.withColumn("bh_equity", F.col("close") / F.col("_p0") * cash).drop("_p0")


# --- bracket trades --------------------------------------------------------------------------


def bracket_levels(direction: Column, entry: Column, width: Column, stop: float, target: float) -> dict[str, Column]:
    """Stop and target prices at multiples of a width (an ATR), mirrored for shorts."""
    sign = F.when(direction == "long", 1.0).otherwise(-1.0)
    return {"stop_price": entry - sign * width * stop, "target_price": entry + sign * width * target}


def ahead(bars, max_bars: int, axis):
    """Add ``path``: the row's bar and its next ``max_bars`` bars (rn, h, l, c), by one look-ahead window."""

    def add(d, a):
        bar = F.struct(F.col("rn").alias("rn"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
        return d.withColumn("path", F.collect_list(bar).over(a.rows(0, max_bars)))

    return windowed(bars, add, axis, lookahead=max_bars)


def first_touch(entries, bars, max_bars: int, axis):
    """Exit of each entry: first bar that touches stop or target within ``max_bars``, else the last bar's close.

    ``entries``: keys, rn, direction, entry_price, stop_price, target_price. ``bars``: keys, order, rn (position in the series), high, low,
    close. The entries of a series meet its bars in one task, and all of them look one bar further at a time; no bar carries its next bars
    along. Series larger than a task take a look-ahead window instead: an entry joins the one row of its bar and folds over its next bars. The stop wins
    when one bar touches both; an entry on the very last bar exits there.
    """
    exits = _exits_by_window if has_hot_key(bars, axis) else _exits_by_series
    g = exits(entries, bars, max_bars, axis)
    move = F.col("exit_price") / F.col("entry_price") - 1
    return g.withColumns({
        "pnl": 100 * F.when(F.col("direction") == "long", move).otherwise(-move), "bars_held": F.col("exit_rn") - F.col("rn"),
    })


def _exits_by_window(entries, bars, max_bars: int, axis):
    keys = list(axis.keys)
    j = entries.join(ahead(bars, max_bars, axis).select(*keys, "rn", "path"), [*keys, "rn"])
    long = F.col("direction") == "long"

    def stopped(x):
        return F.when(long, x["l"] <= F.col("stop_price")).otherwise(x["h"] >= F.col("stop_price"))

    def reached(x):
        return F.when(long, x["h"] >= F.col("target_price")).otherwise(x["l"] <= F.col("target_price"))

    hit = F.get(F.filter("path", lambda x: (x["rn"] > F.col("rn")) & (stopped(x) | reached(x))), F.lit(0))
    last = F.element_at("path", -1)
    j = j.withColumns({"_hit": hit, "_last": last})
    at_stop = stopped(F.col("_hit"))
    touched = F.col("_hit").isNotNull()
    return j.withColumns({
        "exit_rn": F.coalesce("_hit.rn", "_last.rn"),
        "exit_price": F.when(touched, F.when(at_stop, F.col("stop_price")).otherwise(F.col("target_price"))).otherwise(F.col("_last.c")),
        "exit_reason": F.when(touched, F.when(at_stop, "stop").otherwise("target")).otherwise("time"),
    }).drop("_hit", "_last", "path")


def _exits_by_series(entries, bars, max_bars: int, axis):
    keys = list(axis.keys)
    rest = [c for c in entries.columns if c not in (*keys, "rn")]
    entries = entries.select(*keys, "rn", *rest)
    schema = T.StructType([*entries.schema.fields, T.StructField("exit_rn", T.LongType()), T.StructField("exit_price", T.DoubleType()), T.StructField("exit_reason", T.StringType(), False)])

    def numbers(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values of a column, NaN being above all numbers, and where there are any."""
        c = pc.cast(rows[name].combine_chunks(), pa.float64())
        return np.nan_to_num(pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf), pc.is_valid(c).to_numpy(zero_copy_only=False)

    def exits(mine: pa.Table, series: pa.Table) -> pa.Table:
        empty = pa.table({f.name: pa.array([], type=k) for f, k in zip(schema.fields, kinds, strict=True)})
        mine = mine.filter(pc.is_valid(mine["rn"]))
        series = series.filter(pc.is_valid(series["rn"])).sort_by("rn")
        if not len(mine) or not len(series) or any(mine[k][0].as_py() is None for k in keys):
            return empty  # as in a join, a null meets nothing
        found = pd.DataFrame({"rn": mine["rn"].to_numpy(), "_i": np.arange(len(mine))}).merge(pd.DataFrame({"rn": series["rn"].to_numpy(), "_at": np.arange(len(series))}), on="rn")
        i, at = found["_i"].to_numpy(), found["_at"].to_numpy()
        if not len(i):
            return empty
        mine = mine.take(pa.array(i))
        rn, end = series["rn"].to_numpy(), np.minimum(at + max_bars, len(series) - 1)
        (high, h), (low, lo) = numbers(series, "high"), numbers(series, "low")
        (stop, s), (target, t) = numbers(mine, "stop_price"), numbers(mine, "target_price")
        long = pc.fill_null(pc.equal(mine["direction"], "long"), False).to_numpy(zero_copy_only=False)
        hit, stopped = np.full(len(at), -1), np.zeros(len(at), dtype=bool)
        for k in range(1, max_bars + 1):
            x = np.minimum(at + k, len(rn) - 1)
            open_ = (hit < 0) & (at + k <= end) & (rn[x] > rn[at])
            down, up = low[x], high[x]
            at_stop = s & np.where(long, lo[x] & (down <= stop), h[x] & (up >= stop))
            at_target = t & np.where(long, h[x] & (up >= target), lo[x] & (down <= target))
            stopped |= open_ & at_stop
            hit = np.where(open_ & (at_stop | at_target), x, hit)
        touched = hit >= 0
        price = pc.if_else(pa.array(stopped), pc.cast(mine["stop_price"], pa.float64()), pc.cast(mine["target_price"], pa.float64()))
        price = pc.if_else(pa.array(touched), price, pc.cast(series["close"], pa.float64()).take(pa.array(end)))
        reason = np.where(touched, np.where(stopped, "stop", "target"), "time")
        made = [pa.array(rn[np.where(touched, hit, end)].astype(np.int64)), price, pa.array(reason, type=pa.string())]
        return pa.table([*mine.columns, *made], names=[f.name for f in schema.fields])

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    bars = bars.select(*keys, "rn", "high", "low", "close")
    return entries.groupBy(*keys).cogroup(bars.groupBy(*keys)).applyInArrow(exits, schema)


def one_at_a_time(trades, axis):
    """Mark the trades that are taken when only one may be open: entered after the last one's exit."""
    order = Axis(axis.keys, ("rn", "direction"))

    def step(pdf, state):
        busy = state[0] if state is not None else -1.0
        taken = []
        for start, end in zip(pdf["rn"], pdf["exit_rn"]):
            ok = start > busy
            busy = end if ok else busy
            taken.append(bool(ok))
        return {"taken": taken}, [float(busy)]

    return scan(trades, step, "taken boolean", order, needs=["rn", "exit_rn"])


def trade_equity(trades, axis, start: float = 100.0):
    """Equity after each taken trade."""
    taken = trades.where("taken")
    out = running(taken, {"_g": ("sum", compound(F.col("pnl") / 100))}, Axis(axis.keys, ("exit_rn",)))
    return out.withColumn("equity", start * F.exp("_g")).drop("_g")
