"""Self-exciting point processes: intensities, likelihoods, grid estimates and bivariate EM steps.

Everything that fades comes from ``decayed_past``: one pass per grid of parameters, whose points share the sums of their
rate. Log-likelihoods are sums over events; every block gives its part and the parts are added up per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.crosssection import per_group
from tidemark.operators.decay import decayed_past
from tidemark.operators.recurrences import decayed_sum
from tidemark.operators.series import BARS, Axis, has_hot_key, join_same, rows_per_task
from tidemark.session import ensure_checkpoint_dir


def discrete_intensity(df: DataFrame, event: str, alpha: float = 0.8, beta: float = 0.2, out: str = "intensity", axis: Axis = BARS) -> DataFrame:
    """λ[t] = e^{−β} λ[t−1] + α·event[t]."""
    return decayed_sum(df, out, event, float(np.exp(-beta)), alpha, axis)


def _summed(parts: DataFrame, keys: Sequence[str], points: pd.DataFrame, out: str) -> DataFrame:
    """Add up per-block arrays and attach the parameters of each position."""
    flat = parts.select(*keys, F.posexplode("_part").alias("_i", "_v"))
    total = flat.groupBy(*keys, "_i").agg(F.sum("_v").alias(out))
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in row.items()]) for row in points.to_dict("records")])
    p = F.get(table, F.col("_i"))
    return total.select(*keys, *[p[c].alias(c) for c in points.columns], out)


def _parts_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("_part", T.ArrayType(T.DoubleType()))])


def discrete_likelihood(df: DataFrame, event: str, points: Sequence[tuple[float, float, float]], axis: Axis = BARS) -> DataFrame:
    """Discrete log-likelihood per key and (alpha, beta, mu) point, none of them negative; a null event is none.

    The first bar only starts the recursion.
    """
    grid = pd.DataFrame(points, columns=["alpha", "beta", "mu"], dtype=float)
    betas = sorted(set(grid["beta"]))

    def emit(rows, t, past):
        hit = rows[event].to_numpy(dtype=float, na_value=0.0) > 0
        parts = []
        for a, beta, mu in grid.itertuples(index=False):
            level = np.maximum(mu + a * np.exp(beta) * past[betas.index(beta), :, 0], 1e-10)
            parts.append(float((np.where(hit, np.log(level), 0.0) - level)[t > 0].sum()))
        return rows[list(axis.keys)].head(1).assign(_part=[parts])

    slim = df.select(*axis.keys, *axis.order, F.col(event).cast("double").alias(event))
    parts = decayed_past(slim, None, lambda rows: rows[[event]].to_numpy(dtype=float, na_value=0.0), betas, emit, _parts_schema(slim, axis.keys), axis)
    return _summed(parts, axis.keys, grid, "log_likelihood")


def best_by(df: DataFrame, keys: Sequence[str], params: Sequence[str], score: str, largest: bool = True) -> DataFrame:
    """Best grid point per key; the smallest parameters win a tie."""
    sign = F.col(score) if largest else -F.col(score)
    pick = F.max_by(F.struct(*params, score), F.struct(sign, *[-F.col(p) for p in params]))
    return df.groupBy(*keys).agg(pick.alias("_b")).select(*keys, *[F.col(f"_b.{p}").alias(p) for p in params], F.col(f"_b.{score}").alias(score))


def estimate_discrete(df: DataFrame, event: str, alphas: Sequence[float], betas: Sequence[float], mu: float = 0.01, axis: Axis = BARS) -> DataFrame:
    points = [(float(a), float(b), mu) for a in alphas for b in betas]
    return best_by(discrete_likelihood(df, event, points, axis), axis.keys, ["alpha", "beta"], "log_likelihood")


def _known(keys: Sequence[str]) -> Column:
    """A null key takes no part, as in a join on the keys."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def event_times(df: DataFrame, flag: str, axis: Axis = BARS, ts: str = "ts") -> DataFrame:
    """(keys, t, n_events, horizon): event times in days since the first bar, horizon at least one day."""
    keys = list(axis.keys)
    days = lambda c: F.unix_timestamp(c.cast("timestamp")) / 86400.0
    hit = F.col(flag).cast("int")
    rows = df.where(_known(keys)).select(*keys, ts, hit.alias("_hit"))
    rows = per_group(rows, keys, {"_lo": F.min(ts), "_hi": F.max(ts), "n_events": F.sum("_hit")}, has_hot_key(df, axis))
    horizon = F.greatest(days(F.col("_hi")) - days(F.col("_lo")), F.lit(1.0)).alias("horizon")
    return rows.where("_hit = 1").select(*keys, (days(F.col(ts)) - days(F.col("_lo"))).alias("t"), "n_events", horizon)


def exponential_likelihood(events: DataFrame, mu_shares: Sequence[float], alphas: Sequence[float], betas: Sequence[float], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Negative log-likelihood per key and grid point (mu as a share of the plain event rate)."""
    grid = pd.DataFrame([(m, a, b) for m in mu_shares for a in alphas for b in betas], columns=["mu_share", "alpha", "beta"], dtype=float)
    rates = sorted(set(grid["beta"]))

    def emit(rows, t, past):
        horizon = float(rows["horizon"].iloc[0])
        rate, parts = max(float(rows["n_events"].iloc[0]) / horizon, 1e-6), []
        for share, alpha, beta in grid.itertuples(index=False):
            level = share * rate + alpha * beta * past[rates.index(beta), :, 0]
            parts.append(float((alpha * (1 - np.exp(-beta * (horizon - t))) - np.log(level)).sum()))
        return rows[own].head(1).assign(_part=[parts])

    # the parts carry what is constant in a series, so the events are not read again for it
    own = [*keys, "n_events", "horizon"]
    parts = decayed_past(events, "t", lambda rows: np.ones((len(rows), 1)), rates, emit, _parts_schema(events, own), Axis(tuple(keys), ("t",)), each_row=True)
    totals = _summed(parts.where(_known(keys)), own, grid, "_nll")
    rate = F.greatest(F.col("n_events") / F.col("horizon"), F.lit(1e-6))
    out = totals.withColumn("mu", F.col("mu_share") * rate)
    out = out.withColumn("nll", F.col("_nll") + F.col("mu") * F.col("horizon"))
    return out.select(*keys, *grid.columns, "n_events", "horizon", "mu", "nll")


def fit_grid(events: DataFrame, mu_shares, alphas, betas, keys: Sequence[str] = ("symbol",), least: int = 5) -> DataFrame:
    """Grid estimate per key; keys with fewer than ``least`` events have null parameters and no success."""
    ll = exponential_likelihood(events.where(F.col("n_events") >= least), mu_shares, alphas, betas, keys)
    best = best_by(ll, keys, ["mu", "alpha", "beta"], "nll", largest=False)
    every = events.select(*keys, "n_events", "horizon").distinct()
    return every.join(best, list(keys), "left").withColumns({"branching_ratio": F.col("alpha"), "success": F.col("nll").isNotNull()})


def intensity_on_bars(df: DataFrame, flag: str, params: DataFrame, axis: Axis = BARS, ts: str = "ts") -> DataFrame:
    """Intensity at each bar from strictly earlier events, the plain rate and their ratio."""
    keys = list(axis.keys)
    slim = df.select(*keys, ts, F.col(flag).cast("int").alias("_e"), (F.unix_timestamp(F.col(ts).cast("timestamp")) / 86400.0).alias("_t"))
    joined = slim.join(params.select(*keys, "mu", "alpha", "beta", "n_events", "horizon"), keys)

    schema = T.StructType([*joined.schema.fields, T.StructField("_exc", T.DoubleType())])
    done = decayed_past(joined, "_t", lambda rows: rows[["_e"]].to_numpy(dtype=float, na_value=0.0), "beta", lambda rows, t, past: rows.assign(_exc=past[0, :, 0]), schema, axis)
    rate = F.col("n_events") / F.greatest("horizon", F.lit(1.0))
    out = done.withColumns({"hawkes_intensity": F.col("mu") + F.col("alpha") * F.col("beta") * F.col("_exc"), "poisson_intensity": rate})
    return out.withColumn("cluster_ratio", F.when(rate > 0, F.col("hawkes_intensity") / rate)).select(*keys, ts, "hawkes_intensity", "poisson_intensity", "cluster_ratio")


# --- two kinds of events ---------------------------------------------------------------------


def _fading(events: DataFrame, beta: float, axis: Axis, each_row: bool = False) -> DataFrame:
    """Decayed counts of both kinds (``s0``, ``s1``) before each row; a row without a kind counts as neither."""
    schema = T.StructType([*events.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("s0", "s1")]])
    kinds = lambda rows: np.column_stack([rows["kind"].eq(k).to_numpy(dtype=float, na_value=0.0) for k in (0, 1)])
    return decayed_past(events, "t", kinds, [beta], lambda rows, t, past: rows.assign(s0=past[0, :, 0], s1=past[0, :, 1]), schema, axis, 2, each_row)


def _excitations(events: DataFrame, beta: float, keys: Sequence[str]) -> DataFrame:
    """Per event: decayed counts of strictly earlier events of kind 0 and kind 1 (``s0``, ``s1``)."""
    return _fading(events, beta, Axis(tuple(keys), ("t", "kind")))


def bivariate_start(events: DataFrame, horizon: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Start parameters per key: event rates and a flat excitation of 0.1 (no self-excitation without events)."""
    n = events.groupBy(*keys).agg(F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1"))
    p = n.join(horizon, list(keys))
    return p.select(*keys, "horizon", F.greatest(F.col("n0") / F.col("horizon"), F.lit(1e-6)).alias("mu0"), F.greatest(F.col("n1") / F.col("horizon"), F.lit(1e-6)).alias("mu1"),
                    F.when(F.col("n0") > 0, 0.1).otherwise(0.0).alias("a00"), F.lit(0.1).alias("a01"), F.lit(0.1).alias("a10"), F.when(F.col("n1") > 0, 0.1).otherwise(0.0).alias("a11"))


PARAMS = ("mu0", "mu1", "a00", "a01", "a10", "a11")


def bivariate_likelihood(excited: DataFrame, params: DataFrame, beta: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Log-likelihood per key from the decayed counts of each event."""
    j = excited.join(params, list(keys))
    own = F.when(F.col("kind") == 0, F.col("mu0") + F.col("a00") * F.col("s0") + F.col("a01") * F.col("s1")).otherwise(
        F.col("mu1") + F.col("a10") * F.col("s0") + F.col("a11") * F.col("s1"))
    fade = 1 - F.exp(-F.least(beta * (F.col("horizon") - F.col("t")), F.lit(700.0)))
    out = F.when(F.col("kind") == 0, F.col("a00") + F.col("a10")).otherwise(F.col("a01") + F.col("a11")) / beta * fade
    g = j.groupBy(*keys).agg(F.sum(F.log(own)).alias("_l"), F.sum(out).alias("_c"), F.first("mu0").alias("_m0"), F.first("mu1").alias("_m1"), F.first("horizon").alias("_h"))
    return g.select(*keys, (F.col("_l") - F.col("_c") - (F.col("_m0") + F.col("_m1")) * F.col("_h")).alias("log_likelihood"))


def em_step(excited: DataFrame, params: DataFrame, beta: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One expectation-maximisation step as one grouped query; excitations stay below 0.95·beta."""
    j = excited.join(params, list(keys))
    first = F.col("kind") == 0
    mu = F.when(first, F.col("mu0")).otherwise(F.col("mu1"))
    p0 = F.when(first, F.col("a00")).otherwise(F.col("a10")) * F.col("s0")
    p1 = F.when(first, F.col("a01")).otherwise(F.col("a11")) * F.col("s1")
    lam = F.greatest(mu + p0 + p1, F.lit(1e-12))
    fade = 1 - F.exp(-F.least(beta * (F.col("horizon") - F.col("t")), F.lit(700.0)))
    on = lambda k, v: F.sum(F.when(F.col("kind") == k, v).otherwise(0.0))
    g = j.groupBy(*keys, "horizon").agg(
        on(0, mu / lam).alias("i0"), on(1, mu / lam).alias("i1"), on(0, p0 / lam).alias("t00"), on(0, p1 / lam).alias("t01"),
        on(1, p0 / lam).alias("t10"), on(1, p1 / lam).alias("t11"), on(0, fade).alias("d0"), on(1, fade).alias("d1"),
    )
    a = lambda t, d: F.when(F.col(d) > 0, F.least(beta * F.col(t) / F.col(d), F.lit(0.95 * beta))).otherwise(0.0)
    return g.select(*keys, "horizon", F.greatest(F.col("i0") / F.col("horizon"), F.lit(1e-8)).alias("mu0"), F.greatest(F.col("i1") / F.col("horizon"), F.lit(1e-8)).alias("mu1"),
                    a("t00", "d0").alias("a00"), a("t01", "d1").alias("a01"), a("t10", "d0").alias("a10"), a("t11", "d1").alias("a11"))


def _em_sums(kind, s0, s1, fade, p: np.ndarray) -> np.ndarray:
    """What one step needs from some events: background and triggered shares per kind, fades, and the sum of log intensities."""
    first = kind == 0
    mu = np.where(first, p[0], p[1])
    p0, p1 = np.where(first, p[2], p[4]) * s0, np.where(first, p[3], p[5]) * s1
    lam = np.maximum(mu + p0 + p1, 1e-12)
    parts = [mu / lam, p0 / lam, p1 / lam, fade, np.log(lam)]
    return np.array([x[m].sum() for m in (first, ~first) for x in parts])


def _em_next(sums: np.ndarray, horizon: float, beta: float) -> np.ndarray:
    (i0, t00, t01, d0, _), (i1, t10, t11, d1, _) = sums[:5], sums[5:]
    a = lambda t, d: min(beta * t / d, 0.95 * beta) if d > 0 else 0.0
    return np.array([max(i0 / horizon, 1e-8), max(i1 / horizon, 1e-8), a(t00, d0), a(t01, d1), a(t10, d0), a(t11, d1)])


def _log_likelihood(sums: np.ndarray, p: np.ndarray, horizon: float, beta: float) -> float:
    out = (p[2] + p[4]) * sums[3] + (p[3] + p[5]) * sums[8]
    return float(sums[4] + sums[9] - out / beta - (p[0] + p[1]) * horizon)


class _Climb:
    """Accelerated fixed-point search of one key: every third step extrapolates the two before; a worse likelihood takes that back."""

    def __init__(self, start: Sequence[float], horizon: float, beta: float, tol: float):
        self.p, self.horizon, self.beta, self.tol = np.asarray(start, dtype=float), horizon, beta, tol
        self.trail: list[np.ndarray] = []
        self.safe: tuple[np.ndarray, float] | None = None
        self.done, self.ll, self.steps = False, -np.inf, 0

    def take(self, sums: np.ndarray) -> None:
        """One step from the sums at the current parameters."""
        self.steps += 1
        ll = _log_likelihood(sums, self.p, self.horizon, self.beta)
        if self.safe is not None:
            point, before = self.safe
            self.safe = None
            if not ll >= before - 1e-12:
                self.p, self.trail = point, []
                return
        nxt = _em_next(sums, self.horizon, self.beta)
        self.done = bool(np.abs(nxt - self.p).max() < self.tol)
        if self.done:
            self.ll = ll
            return
        self.trail.append(self.p)
        self.p = nxt
        if len(self.trail) == 2:
            r, v = self.trail[1] - self.trail[0], nxt - 2 * self.trail[1] + self.trail[0]
            size = np.linalg.norm(v)
            if size > 0:
                alpha = -np.linalg.norm(r) / size
                jump = self.trail[0] - 2 * alpha * r + alpha * alpha * v
                bound = np.array([np.inf, np.inf, *[0.95 * self.beta] * 4])
                low = np.array([1e-8, 1e-8, 0.0, 0.0, 0.0, 0.0])
                if alpha < -1 and (jump >= low).all() and (jump <= bound).all():
                    self.safe, self.p = (nxt, ll), jump
            self.trail = []

    def result(self) -> list[float]:
        return [*self.p.tolist(), self.ll]


#: events of keys that climb together
_CLIMB_ROWS = 100_000


def _starts(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a key begins in rows sorted by key."""
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for k in keys:
        here, before = rows[k], rows[k].shift()
        new |= (here.ne(before) & ~(here.isna() & before.isna())).to_numpy(dtype=bool)
    return np.flatnonzero(new)


def _climb_all(kind, s0, s1, fade, first, start, horizon, beta: float, tol: float, steps: int):
    """``_Climb`` for all keys at once: (parameters, log-likelihood, settled) per key; ``first`` are the positions of their first events."""
    n = len(first)
    owner = np.repeat(np.arange(n), np.diff(np.append(first, len(kind))))
    p, trail, length = start.copy(), np.zeros((2, n, 6)), np.zeros(n, dtype=int)
    jumped, point, before = np.zeros(n, dtype=bool), np.zeros((n, 6)), np.full(n, -np.inf)
    done, ll = np.zeros(n, dtype=bool), np.full(n, -np.inf)
    low, bound = np.array([1e-8, 1e-8, 0.0, 0.0, 0.0, 0.0]), np.array([np.inf, np.inf, *[0.95 * beta] * 4])
    rows, held = (kind, s0, s1, fade, owner), n
    for _ in range(steps):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        if len(live) < 0.8 * held:  # the events of settled keys are left out
            keep = ~done[rows[4]]
            rows, held = tuple(a[keep] for a in rows), len(live)
        k, x0, x1, fd, own = rows
        zero, q = k == 0, p[own]
        mu = np.where(zero, q[:, 0], q[:, 1])
        p0, p1 = np.where(zero, q[:, 2], q[:, 4]) * x0, np.where(zero, q[:, 3], q[:, 5]) * x1
        lam = np.maximum(mu + p0 + p1, 1e-12)
        parts = (mu / lam, p0 / lam, p1 / lam, fd, np.log(lam))
        sums = np.array([np.bincount(own, np.where(m, v, 0.0), n) for m in (zero, ~zero) for v in parts])[:, live]
        at, h = p[live], horizon[live]
        i0, t00, t01, d0, l0, i1, t10, t11, d1, l1 = sums
        now = l0 + l1 - ((at[:, 2] + at[:, 4]) * d0 + (at[:, 3] + at[:, 5]) * d1) / beta - (at[:, 0] + at[:, 1]) * h
        worse = jumped[live] & ~(now >= before[live] - 1e-12)
        jumped[live] = False
        back = live[worse]
        p[back], length[back] = point[back], 0
        a = lambda t, d: np.where(d > 0, np.minimum(beta * t / np.where(d > 0, d, 1.0), 0.95 * beta), 0.0)
        with np.errstate(all="ignore"):
            nxt = np.column_stack([np.maximum(i0 / h, 1e-8), np.maximum(i1 / h, 1e-8), a(t00, d0), a(t01, d1), a(t10, d0), a(t11, d1)])
        ends = ~worse & (np.abs(nxt - at).max(axis=1) < tol)
        done[live[ends]], ll[live[ends]] = True, now[ends]
        on = ~worse & ~ends
        go, to = live[on], nxt[on]
        trail[length[go], go] = p[go]
        length[go] += 1
        p[go] = to
        two = length[go] == 2
        far, to, was = go[two], to[two], now[on][two]
        r, v = trail[1, far] - trail[0, far], to - 2 * trail[1, far] + trail[0, far]
        size = np.linalg.norm(v, axis=1)
        alpha = -np.linalg.norm(r, axis=1) / np.where(size > 0, size, 1.0)
        jump = trail[0, far] - 2 * alpha[:, None] * r + (alpha * alpha)[:, None] * v
        leap = (size > 0) & (alpha < -1) & (jump >= low).all(axis=1) & (jump <= bound).all(axis=1)
        jumped[far[leap]], point[far[leap]], before[far[leap]], p[far[leap]] = True, to[leap], was[leap], jump[leap]
        length[far] = 0
    return p, ll, done


def fit_bivariate(events: DataFrame, horizon: DataFrame, beta: float = 1.0, keys: Sequence[str] = ("symbol",), steps: int = 2000, tol: float = 1e-9) -> DataFrame:
    """Parameters per key at which an expectation-maximisation step moves none by ``tol``; ``settled`` tells whether it got there.

    The decayed counts do not depend on the parameters and are computed once. Keys that fit a task climb many at a time inside
    one pass over sorted rows. The events of larger keys stay spread: each round adds up partial sums per task, one row per key comes to the driver (a
    bounded number, as each has more than ``rowsPerTask`` events), and settled keys take no further part.
    """
    keys = list(keys)
    ensure_checkpoint_dir(events.sparkSession)
    events = events.checkpoint()  # read for the start parameters, the counts and the size check
    fade = 1 - F.exp(-F.least(beta * (F.col("horizon") - F.col("t")), F.lit(700.0)))
    excited = _excitations(events, beta, keys).join(bivariate_start(events, horizon, keys), keys).withColumn("_fade", fade)
    excited = excited.select(*keys, "horizon", *PARAMS, "kind", "s0", "s1", "_fade")
    key_type = ", ".join(f"`{k}` {excited.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join([key_type, "horizon double", *[f"{p} double" for p in PARAMS], "log_likelihood double", "settled boolean"])
    columns = [*keys, "horizon", *PARAMS, "log_likelihood", "settled"]

    def climb(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        own = rows.iloc[first].reset_index(drop=True)
        values = [rows[c].to_numpy(dtype=float) for c in ("kind", "s0", "s1", "_fade")]
        p, ll, done = _climb_all(*values, first, own[list(PARAMS)].to_numpy(dtype=float), own["horizon"].to_numpy(dtype=float), beta, tol, steps)
        return own[[*keys, "horizon"]].assign(**{c: p[:, i] for i, c in enumerate(PARAMS)}, log_likelihood=ll, settled=done)[columns]

    def climb_sorted(frames):
        """Keys follow one another; enough of them climb together to fill arrays, and none is cut."""
        held, n = [], 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            if n < _CLIMB_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            first = _starts(rows, keys)
            cut = first[-1]
            if cut:
                yield climb(rows.iloc[:cut], first[:-1])
            held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            rows = pd.concat(held, ignore_index=True)
            yield climb(rows, _starts(rows, keys))

    def climbed(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(climb_sorted, schema)

    if not has_hot_key(events, Axis(tuple(keys), ("t",))):
        found = climbed(excited)
    else:
        excited = excited.checkpoint()
        sizes = excited.groupBy(*keys, "horizon", *PARAMS).agg(F.count(F.lit(1)).alias("_n"))
        large = {tuple(r[k] for k in keys): _Climb([r[p] for p in PARAMS], r["horizon"], beta, tol) for r in sizes.where(F.col("_n") > rows_per_task(events.sparkSession)).toLocalIterator()}
        names = events.sparkSession.createDataFrame([(*k, True) for k in large], f"{key_type}, _large boolean")
        marked = join_same(excited, F.broadcast(names), keys, "left")
        rest = climbed(marked.where("_large IS NULL").drop("_large"))
        spread = marked.where("_large").select(*keys, "kind", "s0", "s1", "_fade").checkpoint()
        sums_type = f"{key_type}, {', '.join(f'_{i} double' for i in range(10))}"
        for _ in range(steps):
            at = {k: c.p for k, c in large.items() if not c.done}
            if not at:
                break

            def partial(frames, at=at):
                for pdf in frames:
                    out = [[*k, *_em_sums(*[g[c].to_numpy() for c in ("kind", "s0", "s1", "_fade")], at[k])] for k, g in pdf.groupby(keys, dropna=False) if k in at]
                    yield pd.DataFrame(out, columns=[*keys, *[f"_{i}" for i in range(10)]])

            for r in spread.mapInPandas(partial, sums_type).groupBy(*keys).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(10)]).toLocalIterator():
                large[tuple(r[k] for k in keys)].take(np.array([r[f"_{i}"] for i in range(10)]))
        rows = [(*k, float(c.horizon), *c.result(), c.done) for k, c in large.items()]
        found = rest.unionByName(events.sparkSession.createDataFrame(rows, schema))
    return found.withColumns({"branching0": (F.col("a00") + F.col("a01")) / beta, "branching1": (F.col("a10") + F.col("a11")) / beta})


def bivariate_intensity(events: DataFrame, times: DataFrame, params: DataFrame, beta: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Intensities of both kinds at given times, events at the same time included."""
    stacked = events.select(*keys, "t", "kind", F.lit(0).alias("_side")).unionByName(times.select(*keys, "t", F.lit(None).cast("int").alias("kind"), F.lit(1).alias("_side")))

    done = _fading(stacked, beta, Axis(tuple(keys), ("t", "_side")), each_row=True).where("_side = 1").join(params, list(keys))
    return done.select(*keys, "t", (F.col("mu0") + F.col("a00") * F.col("s0") + F.col("a01") * F.col("s1")).alias("intensity0"),
                       (F.col("mu1") + F.col("a10") * F.col("s0") + F.col("a11") * F.col("s1")).alias("intensity1"))
