from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import hawkes as hk
from tidemark.operators import tables as tb
from tidemark.operators.frames import Frame
from tidemark.operators.series import Axis, windowed
from tidemark.streaming import trades as st

AXIS = Axis(("k",), ("t",))


@pytest.fixture()
def rows(spark):
    rng, out = np.random.default_rng(3), []
    for key, n in (("a", 40), ("b", 3), (None, 25), ("c", 1)):
        for t in range(n):
            x = None if rng.random() < 0.15 else float("nan") if key == "b" and t == 1 else 2.5 if key == "a" and t > 30 else float(rng.normal())
            out.append((key, t, x, None if rng.random() < 0.1 else float(rng.normal())))
    return spark.createDataFrame(out, "k string, t int, x double, y double")


def plain(column, least, n, w):
    return F.when(F.count("x").over(w) >= least, column.over(w))


def same(df, names):
    for r in df.collect():
        for c in names:
            a, b = r[f"f_{c}"], r[f"w_{c}"]
            assert (a is None) == (b is None) and (a is None or a == b or math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12), (c, r)


@pytest.mark.parametrize("tiny_tasks", ["1000000", "20"], indirect=True)
def test_frames_equal_windows_across_batches(spark, rows, tiny_tasks):
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    pairs = {"var_samp": F.var_samp("x"), "std_samp": F.stddev_samp("x"), "var_pop": F.var_pop("x"), "mean": F.avg("x"), "sum": F.sum("x"), "min": F.min("x"), "max": F.max("x"),
             "quantile": F.percentile("x", F.lit(0.9))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def add(d, a):
            w = a.trailing(9)
            d = d.withColumns({f"w_{c}": plain(v, 4, 9, w) for c, v in pairs.items()})
            d = d.withColumns({"w_covar_samp": F.covar_samp("x", "y").over(w), "w_covar_pop": F.covar_pop("x", "y").over(w)})
            d = d.withColumn("w_rows", F.when(F.count(F.lit(1)).over(w) >= 9, F.sum("y").over(w)))
            spread = F.stddev_pop(F.when(both, F.col("x"))).over(w) * F.stddev_pop(F.when(both, F.col("y"))).over(w)
            d = d.withColumn("w_corr", F.covar_pop("x", "y").over(w) / F.nullif(spread, F.lit(0.0)))
            return fr.framed(d, {**{f"f_{c}": Frame(c, "x", 9, 4, 0.9) for c in pairs}, "f_covar_samp": Frame("covar_samp", ("x", "y"), 9), "f_covar_pop": Frame("covar_pop", ("x", "y"), 9),
                                 "f_rows": Frame("sum", "y", 9, 9, gate="*"), "f_corr": Frame("corr", ("x", "y"), 9)}, a)

        found = windowed(rows, add, AXIS, lookback=9)
        same(found, [*pairs, "covar_samp", "covar_pop", "rows", "corr"])
        assert found.count() == 69
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_queries_slide_on_arrays(spark, folder):
    from tidemark.plans import catalog

    for name in ("rolling_basic", "rolling_risk", "sleeve_filters", "exponential_likelihood", "intensity_on_bars"):
        text = plan(catalog.load().QUERIES[name](spark, folder))
        assert "MapInArrow" in text and "specifiedwindowframe(RowFrame, -19" not in text and "specifiedwindowframe(RowFrame, -59" not in text, name


def test_routers_deal_rows_by_what_a_task_sorts(spark, folder):
    from tidemark.plans import catalog

    assert "REPARTITION_BY_NUM" in plan(catalog.load().QUERIES["signal_routers"](spark, folder))


def test_days_are_completed_without_a_join(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 2.0), ("a", day(3), 3.0), ("b", day(5), None), (None, day(0), 4.0), (None, day(2), 5.0), (None, day(2), 6.0), ("a", None, 7.0)],
                               "symbol string, ts date, close double")
    found = tb.calendar_complete(df, "symbol", "ts")
    assert "Join" not in plan(found)
    spans = df.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spans.select("symbol", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("ts"))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found.collect(), key=key) == sorted(grid.join(df, ["symbol", "ts"], "left").collect(), key=key)


def test_event_times_reads_its_rows_once(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    df = spark.createDataFrame([("a", day(0), 0), ("a", day(2), 1), ("a", day(9), 1), ("b", day(1), 1), (None, day(1), 1)], "symbol string, ts date, ev int")
    found = hk.event_times(df, "ev")
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", 2.0, 2, 9.0), ("a", 9.0, 2, 9.0), ("b", 0.0, 1, 1.0)]


def test_keys_that_climb_together_arrive_where_each_arrives_alone():
    rng, beta = np.random.default_rng(5), 0.1
    sizes = [30, 1, 55, 8]
    first = np.cumsum([0, *sizes[:-1]])
    kind = rng.integers(0, 2, sum(sizes))
    s0, s1, fade = rng.random((3, len(kind))) * 4
    start, horizon = np.tile([0.05, 0.04, 0.1, 0.1, 0.1, 0.1], (4, 1)), np.array([300.0, 20.0, 500.0, 90.0])
    p, ll, done = hk._climb_all(kind, s0, s1, fade, first, start, horizon, beta, 1e-9, 2000)
    for i, n in enumerate(sizes):
        one, at = hk._Climb(start[i], horizon[i], beta, 1e-9), slice(first[i], first[i] + n)
        while not one.done and one.steps < 2000:
            one.take(hk._em_sums(kind[at], s0[at], s1[at], fade[at], one.p))
        assert done[i] == one.done and np.allclose(p[i], one.p, atol=1e-7) and abs(ll[i] - one.ll) < 1e-6


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class Entries(dict):
    def updateValue(self, k, v):
        self[k] = v

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Entries()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_lie_in_the_state_and_not_in_memory(monkeypatch):
    monkeypatch.setattr(st, "_ROWS_AT_ONCE", 50)
    rng = np.random.default_rng(7)
    hours = 12
    us = rng.permutation(np.repeat(np.arange(0, hours * 3600, 30), 2)) * 1_000_000
    all_rows = pd.DataFrame({"us": us, "value": np.arange(len(us), dtype=float), "is_side": rng.random(len(us)) < 0.3})
    one, held = st.LastKnown(), []
    one.init(Handle())
    put = one._keep
    monkeypatch.setattr(one, "_keep", lambda frames: (held.append(sum(map(len, frames))), put(frames)))
    assert sum(map(len, one.handleInputRows(("a",), (all_rows.iloc[i : i + 10] for i in range(0, len(us), 10)), Clock(0)))) <= 2
    assert max(held) <= 50 and len(one.waiting) >= hours
    assert one.handle.timers == [int(us.max()) // 1000 + 1]
    out = []
    for ms in (hours * 1_800_000 + 15_000, hours * 3_600_000):
        pieces = list(one.handleExpiredTimer(("a",), Clock(ms), None))
        assert max(map(len, pieces)) <= 240
        out += pieces
    found = pd.concat(out)
    wanted, last = [], None
    for r in all_rows.assign(o=~all_rows["is_side"]).sort_values(["us", "o"], kind="stable").itertuples():
        if r.is_side:
            last = r.value
        elif r.us > 0:
            wanted.append((r.us, r.value, last))
    got = [(int(u), c, None if np.isnan(s) else s) for u, c, s in zip(found["us"], found["close"], found["side_value"], strict=True)]
    assert [g for g in got if g[0] > 0] == wanted and not one.waiting
