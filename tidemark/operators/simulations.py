"""Equity curves of a series on arrays: all curves of a stretch of rows at once.

A curve (a simulated path, a point of a grid) is a column of a matrix, a row of the series its row. What is asked of the curves (bands per row,
metrics per curve) is taken from the matrix where it is made, so neither a row per curve nor the matrix leaves the task. Series run over the end of a
stretch with the state of their curves. Weights are held between rows as by ``backtest.target_backtest`` with every row trading.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.noise import normals, plain_uniform
from tidemark.operators.frames import Frame
from tidemark.operators.passes import Trailing, Values
from tidemark.operators.series import Axis, positions, spread, windowed

@dataclass(frozen=True)
class Simulation:
    """Equity paths under signal noise and a delay of each path."""

    df: DataFrame
    signal: str
    sims: int
    noise_bps: float
    delays: tuple[int, int]
    seed: int
    cost_bps: float
    axis: Axis
    at_once: int = 200_000  # values of paths that lie in memory at a time, about

    def bands(self, qs: Sequence[int]) -> DataFrame:
        """Percentiles of all paths per key and time."""
        by = [*self.axis.keys, *self.axis.order]
        return self._run(by, {f"p{q}": T.DoubleType() for q in qs}, _Bands([q / 100 for q in qs]))

    def curves(self) -> DataFrame:
        """Rows, first and last equity, deepest drawdown and moments of the returns of each path."""
        return self._run(list(self.axis.keys), {"sim": T.IntegerType(), **_Curves.kinds}, _Curves([np.arange(self.sims, dtype=np.int32)]))

    def _run(self, keep: list[str], added: dict[str, T.DataType], outcome) -> DataFrame:
        lo, hi = self.delays
        keys, late = list(self.axis.keys), {f"_d{k}": k for k in range(lo, hi + 1)}

        def add(d: DataFrame, a: Axis) -> DataFrame:
            return d.withColumns({c: F.lag(self.signal, k, 0.0).over(a.spec()) for c, k in late.items()})

        df = windowed(positions(spread(self.df, self.axis, self.sims), self.axis), add, self.axis, lookback=hi)
        df = df.withColumn("_head", F.concat_ws(":", F.lit(""), *[F.col(k).cast("string") for k in keys]))
        walk = _Walk(_Shaken(self), self.sims, self.cost_bps, max(self.at_once // self.sims, 1), outcome, keep, list(added))
        return _walked(df, self.axis, walk, ["_head", *late], added)


@dataclass(frozen=True)
class Grid:
    """Curves of the SMA-cross rule, one per point (fast, slow)."""

    df: DataFrame
    points: Sequence[Mapping]
    axis: Axis
    cost_bps: float
    at_once: int = 131_072  # values of curves that lie in memory at a time, about

    def curves(self) -> DataFrame:
        """Rows, first and last equity, deepest drawdown and moments of the returns of each curve."""
        names = ("fast", "slow")
        walk = _Walk(_Crossed(self.points), len(self.points), self.cost_bps, max(self.at_once // len(self.points), 1),
                     _Curves([np.array([p[n] for p in self.points], dtype=np.int32) for n in names]), list(self.axis.keys), [*names, *_Curves.kinds])
        return _walked(positions(self.df, self.axis, "rn"), self.axis, walk, [], {**{n: T.IntegerType() for n in names}, **_Curves.kinds})


def _walked(df: DataFrame, axis: Axis, walk: _Walk, reads: Sequence[str], added: Mapping[str, T.DataType]) -> DataFrame:
    """What the walk over the rows of ``df`` finds; ``rn`` is the position of a row in its series, which fits a task."""
    keys, order = list(axis.keys), list(axis.order)
    same, known = F.lit(True), F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(axis.spec()))
    for c in (*keys, *order):
        known = known & F.col(c).isNotNull()
    df = df.withColumns({"_new": (F.col("rn") == 0) | ~same, "_known": known, "_dated": F.col(order[0]).isNotNull()})
    df = df.select(*dict.fromkeys([*keys, *walk.keep, "rn", "close", "_known", "_dated", "_new", *reads]))
    schema = T.StructType([*[df.schema[c] for c in walk.keep], *[T.StructField(c, t) for c, t in added.items()]])
    target = to_arrow_schema(schema)

    def run(batches):
        for made in walk.through(batches):
            yield from made.cast(target).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


class _Shaken:
    """Late signals under noise: the weights of simulated paths."""

    def __init__(self, sim: Simulation):
        lo, hi = sim.delays
        of = [lo + int(plain_uniform(sim.seed, i, salt="delay") * (hi - lo + 1) // 1) for i in range(sim.sims)]
        self.groups = [(k, np.array([i for i in range(sim.sims) if of[i] == k])) for k in range(lo, hi + 1) if k in of]
        self.sims, self.seed, self.noise = sim.sims, sim.seed, sim.noise_bps / 10_000

    def of(self, rows: pa.Table, at: np.ndarray, stretches: Sequence[tuple[int, int]]):
        for a, z in stretches:
            yield self._weights(rows.slice(a, z - a), at[a:z])

    def _weights(self, rows: pa.Table, at: np.ndarray) -> np.ndarray:
        """Weights of a series' rows; null is NaN."""
        w, head = np.zeros((len(at), self.sims)), rows["_head"][0].as_py()
        for k, paths in self.groups:
            here = at >= k
            if not here.any():
                continue
            late = rows[f"_d{k}"].combine_chunks().filter(pa.array(here))
            base = pc.fill_null(pc.cast(late, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            shaken = base[:, None] + normals(self.seed, head, paths, at[here] - k) * self.noise
            shaken = np.fmax(np.fmin(shaken, 1.0), -1.0)
            shaken[pc.is_null(late).to_numpy(zero_copy_only=False)] = np.nan
            w[np.ix_(here, paths)] = shaken
        return w


class _Crossed:
    """Whole weight while the fast mean lies above the slow one."""

    def __init__(self, points: Sequence[Mapping]):
        self.points = [(p["fast"], p["slow"]) for p in points]
        self.means = Trailing({f"m{n}": Frame("mean", "close", n, n) for n in sorted({n for p in self.points for n in p})})
        self.state = None

    def of(self, rows: pa.Table, at: np.ndarray, stretches: Sequence[tuple[int, int]]):
        found, self.state = self.means.run({"close": Values(*_numbers(rows["close"]))}, at, None if at[0] == 0 else self.state)
        held = [found[f"m{f}"].known & found[f"m{s}"].known & (found[f"m{f}"].x > found[f"m{s}"].x) for f, s in self.points]
        w = np.stack(held, axis=1).astype(float)
        for a, z in stretches:
            yield w[a:z]


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.float64()), np.nan).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


class _Walk:
    """The curves of the series of a task, stretch by stretch."""

    def __init__(self, source, paths: int, cost_bps: float, most: int, outcome, keep: list[str], added: list[str], cash: float = 10_000.0):
        self.source, self.paths, self.cost, self.most, self.cash = source, paths, cost_bps * 1e-4, most, cash
        self.outcome, self.keep, self.added = outcome, keep, added

    def through(self, batches: Iterable[pa.RecordBatch]):
        state, kinds = None, None
        for rows in _whole_times(batches, self.most):
            kinds = kinds or [rows.schema.field(k).type for k in self.keep]
            flag = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            at, new, known, dated = (flag(c) for c in ("rn", "_new", "_known", "_dated"))
            p, priced = _numbers(rows["close"])
            cuts = [0, *[int(i) for i in np.flatnonzero(at == 0) if i], len(at)]
            stretches, ended, made = list(zip(cuts, cuts[1:])), [], []
            for (a, z), w in zip(stretches, self.source.of(rows, at, stretches), strict=True):
                if at[a] == 0:
                    if state is not None:
                        ended.append(state)
                    state = {"keys": [rows[k][a].as_py() for k in self.keep]}
                equity, of, state = self._stretch(state, w, p[a:z], priced[a:z], known[a:z], new[a:z])
                found, state["out"] = self.outcome.take(equity, of, new[a:z], dated[a:z], state.get("out"))
                if found is not None:
                    made.append(found)
            if made:
                first = rows.filter(pa.array(new))
                yield pa.table([*[first[k] for k in self.keep], *[np.concatenate(c) for c in zip(*made)]], names=[*self.keep, *self.added])
            yield from self._end(ended, kinds)
        if state is not None:
            yield from self._end([state], kinds)

    def _end(self, ended: list[dict], kinds):
        found = [f for s in ended if (f := self.outcome.end(s["out"])) is not None]
        if found:
            keys = [pa.array([s["keys"][i] for s in ended for _ in range(self.paths)], type=kind) for i, kind in enumerate(kinds)]
            yield pa.table([*keys, *[pa.concat_arrays(c) for c in zip(*found)]], names=[*self.keep, *self.added])

    def _stretch(self, state: dict, w: np.ndarray, p: np.ndarray, priced: np.ndarray, known: np.ndarray, new: np.ndarray):
        """Equity of all curves over rows of one series, the rows it belongs to, and the state behind them."""
        c = self.cost
        if "w" not in state:
            nil = np.full(self.paths, np.nan)
            state |= {"w": nil, "tau": nil, "log": np.zeros(self.paths), "p": np.nan, "priced": False, "node": None}
        w0, p0 = np.concatenate([state["w"][None], w[:-1]]), np.concatenate([[state["p"]], p[:-1]])
        both = priced & np.concatenate([[state["priced"]], priced[:-1]])
        with np.errstate(all="ignore"):
            move = (p / p0)[:, None]
            gain = w0 * (move - 1)
            moved = both[:, None] & ~np.isnan(w0)
            tau = np.abs(w - np.where(moved, w0 * move / (1 + gain), 0.0))
            tau0 = np.concatenate([state["tau"][None], tau[:-1]])
            grown = np.where(moved & ~np.isnan(tau0), 1 - c * tau0 + gain, 1.0)
            steps = np.log(np.maximum(grown, 1e-12))
            steps[0] += state["log"]
            logs = np.cumsum(steps, axis=0)
            equity, of, node = self._equity(known, new, np.exp(logs), tau, w, p, state["node"])
        return equity, of, state | {"w": w[-1], "tau": tau[-1], "log": logs[-1], "p": p[-1], "priced": bool(priced[-1]), "node": node}

    def _equity(self, known: np.ndarray, new: np.ndarray, e, tau, w, p, node):
        """Equity of each row at the last node (its own, if key and time are known), the rows it belongs to, and the last node.

        Rows of one key and time each meet all nodes of that time, the last one first, as a join of the nodes to their rows gives them.
        """
        n = len(known)
        of = np.arange(n)
        if known.all() and new.all():
            equity = self.cash * e * (1 - self.cost * tau + w * (p / p - 1)[:, None])
            return np.where(np.isnan(equity), self.cash, equity), of, (e[-1], tau[-1], w[-1], p[-1])
        nodes = np.maximum.accumulate(np.where(known, of, -1))
        last = int(nodes[-1])
        if not new.all():
            first, pairs = np.flatnonzero(new), []
            for a, z in zip(first, [*first[1:], n]):
                pairs += [(i, j) for i in range(a, z) for j in range(z - 1, a - 1, -1)] if z - a > 1 and known[a] else [(i, nodes[i]) for i in range(a, z)]
            of, nodes = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])
        after = node if last < 0 else (e[last], tau[last], w[last], p[last])
        e, tau, w, q = e[nodes], tau[nodes], w[nodes], p[nodes]
        earlier = nodes < 0
        if node is not None:
            e[earlier], tau[earlier], w[earlier], q[earlier] = node
        else:
            e[earlier] = np.nan
        equity = self.cash * e * (1 - self.cost * tau + w * (p[of] / q - 1)[:, None])
        return np.where(np.isnan(equity), self.cash, equity), of, after


def _whole_times(batches: Iterable[pa.RecordBatch], most: int):
    """Tables of about ``most`` rows; rows of one key and time stay together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > most:
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = _cuts(table, most)
            # the last time may go on in the next batch
            for a, z in cuts[:-1]:
                yield table.slice(a, z - a)
            rest = table.slice(cuts[-1][0])
            held, rows = rest.to_batches(), len(rest)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        for a, z in _cuts(table, most):
            yield table.slice(a, z - a)


def _cuts(rows: pa.Table, most: int) -> list[tuple[int, int]]:
    """Stretches of at most ``most`` rows, or of one time where that has more."""
    starts, cuts, a = np.flatnonzero(rows["_new"].combine_chunks().to_numpy(zero_copy_only=False)), [], 0
    while len(rows) - a > most:
        last = int(np.searchsorted(starts, a + most, side="right")) - 1
        if starts[last] <= a:
            last += 1
        if last >= len(starts):
            break
        cuts.append((a, int(starts[last])))
        a = int(starts[last])
    return [*cuts, (a, len(rows))]


class _Bands:
    """Interpolated percentiles per time."""

    def __init__(self, shares: Sequence[float]):
        self.shares = shares

    def take(self, equity, of, new, dated, state):
        if new.all():
            ranked = np.sort(equity, axis=1)
            return [self._at(ranked, s) for s in self.shares], None
        group = (np.cumsum(new) - 1)[of]
        ranked = [np.sort(equity[group == g], axis=None)[None] for g in range(int(group[-1]) + 1)]
        return [np.concatenate([self._at(r, s) for r in ranked]) for s in self.shares], None

    def _at(self, ranked: np.ndarray, share: float) -> np.ndarray:
        place = share * (ranked.shape[1] - 1)
        low, high = int(np.floor(place)), int(np.ceil(place))
        a, b = ranked[:, low], ranked[:, high]
        return np.where((a == b) | (low == high), a, (high - place) * a + (place - low) * b)

    def end(self, state):
        return None


class _Curves:
    """What the metrics of a curve are made of, for each path."""

    kinds = {"_n": T.LongType(), **{c: T.DoubleType() for c in ("_first", "final_equity", "_dd", "_m", "_s", "_dn", "_ds")}}

    def __init__(self, labels: Sequence[np.ndarray]):
        self.labels = labels

    def take(self, equity, of, new, dated, state):
        with np.errstate(all="ignore"):
            before = np.vstack([equity[:1] if state is None else state["last"], equity[:-1]])
            r = equity / np.where(before == 0, np.nan, before) - 1
            r = np.where(np.isnan(r), 0.0, r)
            peaks = np.maximum.accumulate(equity if state is None else np.vstack([np.maximum(state["peak"], equity[0]), equity[1:]]), axis=0)
            deepest = (equity / peaks - 1).min(axis=0)
        fall = r < 0
        mine = {"all": self._moments(r, np.ones_like(fall)), "down": self._moments(r, fall), "dd": deepest, "first": None, "final": None}
        at = np.flatnonzero(dated[of])
        if len(at):
            # of rows with the least (greatest) time the last one counts
            time = (np.cumsum(new) - 1)[of]
            mine |= {"first": equity[np.flatnonzero(time == time[at[0]])[-1]], "final": equity[at[-1]]}
        if state is not None:
            mine = {"all": self._both(state["all"], mine["all"]), "down": self._both(state["down"], mine["down"]), "dd": np.minimum(state["dd"], deepest),
                    "first": mine["first"] if state["first"] is None else state["first"], "final": state["final"] if mine["final"] is None else mine["final"]}
        return None, mine | {"last": equity[-1], "peak": peaks[-1]}

    def _moments(self, r, taken):
        n = taken.sum(axis=0).astype(float)
        mean = np.where(taken, r, 0.0).sum(axis=0) / np.maximum(n, 1)
        return n, mean, (np.where(taken, r - mean, 0.0) ** 2).sum(axis=0)

    def _both(self, a, b):
        n = np.maximum(a[0] + b[0], 1)
        gap = b[1] - a[1]
        return a[0] + b[0], a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n

    def end(self, state):
        n, mean, squares = state["all"]
        dn, _, down = state["down"]
        spread_of = lambda k, s: pa.array(np.sqrt(s / np.maximum(k - 1, 1)), mask=k < 2)
        some = lambda v: pa.nulls(len(mean), pa.float64()) if v is None else pa.array(v)
        return [*[pa.array(v) for v in self.labels], pa.array(n.astype(np.int64)), some(state["first"]), some(state["final"]), pa.array(state["dd"]), pa.array(mean), spread_of(n, squares),
                pa.array(dn), spread_of(dn, down)]
