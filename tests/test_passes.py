"""Ordered steps in one pass give what windows and recurrences behind each other give."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import spark_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import indicators as ind
from tidemark.operators import passes as ps
from tidemark.operators.frames import Frame
from tidemark.operators.recurrences import ewm_mean
from tidemark.operators.series import Axis, roll_max, roll_std, roll_sum, windowed

AXIS = Axis(("k",), ("t",))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol")


@pytest.fixture()
def rows(spark):
    rng, out = np.random.default_rng(4), []
    for key, n in (("a", 60), ("b", 2), (None, 25), ("c", 1), ("d", 18)):
        for t in range(n):
            out.append((key, t, None if rng.random() < 0.2 or (key == "d" and t < 9) else float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(out, "k string, t int, x double, y double")


@pytest.mark.parametrize("tiny_tasks", ["1000000", "20"], indirect=True)
@pytest.mark.parametrize("at_once", [1, 7, 32_768])
def test_steps_equal_windows_and_recurrences(spark, rows, tiny_tasks, at_once, monkeypatch):
    monkeypatch.setattr(ps, "_ROWS_AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(at_once, 10_000)))
    try:
        plain = ewm_mean(rows, {"m": ("x", 0.2, 3), "f": ("y", 0.5, 1), "s": ("x", 0.5, 2)}, AXIS).withColumn("z", F.col("m") - F.col("f"))
        plain = ewm_mean(plain, {"mm": ("z", 0.1, 2)}, AXIS)

        def add(d, a):
            past = F.collect_list("y").over(a.trailing(4))
            return d.withColumns({
                "top": roll_max("mm", a, 5, 2), "sd": roll_std("x", a, 6, 3), "back": F.lag("x", 3).over(a.spec()), "sum": roll_sum("y", a, 4),
                "w": F.when(F.size(past) >= 4, F.aggregate(F.transform(past, lambda v, i: v * (i + 1)), F.lit(0.0), lambda p, v: p + v) / 10),
                "dev": F.when(F.size(past) >= 4, F.aggregate(F.transform(past, lambda v: F.abs(v - F.avg("y").over(a.trailing(4)))), F.lit(0.0), lambda p, v: p + v) / 4),
            })

        plain = windowed(plain, add, AXIS, lookback=60)
        steps = [
            ps.Means({"m": ("x", 0.2, 3), "f": ("y", 0.5, 1), "s": ("x", 0.5, 2)}), ps.Made({"z": lambda x: x["m"] - x["f"]}, ("m", "f")), ps.Means({"mm": ("z", 0.1, 2)}),
            ps.Trailing({"top": Frame("max", "mm", 5, 2), "sd": Frame("std_samp", "x", 6, 3), "back": Frame("first", "x", 4), "sum": Frame("sum", "y", 4, 4),
                         "w": Frame("weighted", "y", 4, 4), "dev": Frame("mean_abs_dev", "y", 4, 4)}),
        ]
        names = [n for s in steps for n in s.names()]
        found = ps.ordered(rows, steps, AXIS, ["k", "t", "x", "y"], names)
        assert spark_rows(found.select(*plain.columns)) == spark_rows(plain)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_step_that_divides_by_nothing_gives_null(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0, 1.0, 1.0, 1.0, "g") for i in range(40)], "symbol string, ts int, open double, high double, low double, close double, volume double, asset_group string")
    out = ind.core_summary(df).where("ts = 39").first()
    assert out.rsi_14 is None and out.adx_14 is None and out.cci_20 is None and out.stoch_k is None and out.sma_20 == 1.0 and out.atr_14 == 0.0


@pytest.mark.parametrize("name", ["core_indicator_summary", "default_feature_block", "atr_keltner_power"])
def test_wide_rows_are_not_dealt_again(spark, folder, name):
    """F1, F8, F12: bars are dealt by their key once, before anything is made of them."""
    assert exchanges(entry.queries()[name](spark, folder)) == 1


def test_bars_are_joined_by_the_key_of_their_series(spark, folder):
    from tidemark.sources import bindings

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = windowed(bindings.bars(spark, folder), lambda d, a: d.withColumn("m", roll_sum("close", a, 5)))
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol") == 2  # bars, and their groups
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latent_states_reads_its_features_once(spark, folder, monkeypatch):
    """bars were dealt again behind each recurrence, and all features were made a second time for the statistics of the states."""
    from tidemark.operators import learning as ml
    from tidemark.operators import volatility as vol
    from tidemark.sources import bindings

    df = vol.market_indicators(bindings.bars(spark, folder), windows=(20,))
    assert exchanges(df) == 1
    rows, summary = ml.latent_states(df, 2)
    assert "MapInArrow" not in summary._jdf.queryExecution().executedPlan().toString()
    again = {r["state"]: r for r in rows.groupBy("state").agg(F.count(F.lit(1)).alias("rows"), F.avg("rv_close_20").alias("mean_vol"), F.first("regime").alias("regime")).collect()}
    found = summary.collect()
    assert len(found) == len(again) and all(r["rows"] == again[r["state"]]["rows"] and abs(r["mean_vol"] - again[r["state"]]["mean_vol"]) < 1e-9 and r["regime"] == again[r["state"]]["regime"] for r in found)


def test_tree_models_read_rows_that_were_made_once(spark, folder, monkeypatch):
    """every fit and every set of predictions made the features anew, and each fit held a wide copy of them."""
    from tidemark.operators import learning as ml

    kept, plain = [], ml.held.__wrapped__
    monkeypatch.setattr(ml, "held", __import__("contextlib").contextmanager(lambda df: kept.append(df.columns) or (yield from plain(df))))
    out = entry.queries()["tree_regressors"](spark, folder)
    assert kept == [["ret", "mean_5", "std_20", "label", "is_train"]]
    assert "parquet" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 6
