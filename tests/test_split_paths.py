"""A key too large for a task must give the rows of the one-exchange plan."""

from __future__ import annotations

import pytest
from helpers import spark_rows

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()

SPLIT = [
    "rolling_basic", "expanding_aggregates", "ewm_mean_std", "fills", "asof_backward", "asof_forward", "islands", "signal_mean_reversion",
    "cusum_breakouts", "target_weight_backtest", "flow_and_vpin", "exact_quantiles", "winsorise_quantiles", "tail_labels",
    "discrete_likelihood", "exponential_likelihood", "intensity_on_bars", "bivariate_likelihood", "bivariate_intensity", "decay_context",
]


@pytest.mark.parametrize("tiny_tasks", ["300"], indirect=True)
@pytest.mark.parametrize("name", SPLIT)
def test_split_equals_sql(spark, folder, tiny_tasks, name):
    from helpers import connect, sql_rows

    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(connect(folder), SQL[name])


ROWS = [("a", 1, 1.0), ("a", None, 2.0), (None, 3, 3.0), (None, 1, None), ("a", 5, 5.0), ("b", 2, 6.0), ("a", 3, 7.0), ("b", 2000, 8.0), (None, 2, 9.0), ("b", None, None)]


def same_on_both_paths(spark, build):
    from tidemark.operators.series import ROWS_PER_TASK

    plain = spark_rows(build())
    spark.conf.set(ROWS_PER_TASK, "3")
    try:
        assert spark_rows(build()) == plain
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    assert len(plain[1]) == len(ROWS)


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "string"])
def test_null_keys_and_times_stay(spark, kind):
    from pyspark.sql import functions as F

    from tidemark.operators import series as sr
    from tidemark.operators.recurrences import decayed_sum, ewm_mean

    casts = {
        "int": F.col("k"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")),
        "timestamp": F.timestamp_seconds(F.col("k") * 1000), "string": F.lpad(F.col("k").cast("string"), 6, "0"),
    }
    df = spark.createDataFrame(ROWS, "symbol string, k int, x double").withColumn("ts", casts[kind])
    # ties between null times are broken by the value
    axis = sr.Axis(("symbol",), ("ts", "x"))
    same_on_both_paths(spark, lambda: sr.positions(df, axis))
    same_on_both_paths(spark, lambda: sr.running(df, {"s": ("sum", "x"), "l": ("last", "x"), "n": ("count", "x")}, axis))
    same_on_both_paths(spark, lambda: sr.windowed(df, lambda d, a: d.withColumn("m", sr.roll_sum("x", a, 2, 1)), axis, lookback=2))
    same_on_both_paths(spark, lambda: ewm_mean(df, {"e": ("x", 0.3, 1)}, axis))
    same_on_both_paths(spark, lambda: decayed_sum(df, "d", "x", 0.5, 1.0, axis))


def test_crowded_bucket_is_split(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import series as sr

    df = spark.range(600).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"))
    spark.conf.set(sr.ROWS_PER_TASK, "50")
    try:
        got = sr.positions(df, sr.BARS).collect()
    finally:
        spark.conf.unset(sr.ROWS_PER_TASK)
    assert all(r.rn == r.ts for r in got)


def test_calendar_windows_of_intraday_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import series as sr
    from tidemark.operators.sessions import padded_days, trailing_days

    df = spark.range(240).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("double").alias("x"))
    for build in (lambda: trailing_days(df, 3, "x"), lambda: padded_days(df, 3, "x", 80)):
        plain = spark_rows(build())
        spark.conf.set(sr.ROWS_PER_TASK, "60")
        try:
            assert spark_rows(build()) == plain
        finally:
            spark.conf.unset(sr.ROWS_PER_TASK)


@pytest.mark.parametrize("name, most", [("walk_forward", 2), ("ewm_mean_std", 1), ("candidate_matrix", 2), ("discrete_likelihood", 1), ("monte_carlo_bands", 1)])
def test_counts_while_building(spark, folder, monkeypatch, name, most):
    """The size of the largest key is asked once per source, not once per operator."""
    from tidemark.operators import series as sr

    asked = []
    count = sr.largest_key
    monkeypatch.setattr(sr, "largest_key", lambda df, keys: asked.append(keys) or count(df, keys))
    sr._LARGEST.clear()
    QUERIES[name](spark, folder)
    assert len(asked) <= most, asked


def test_scratch_folder_needs_a_local_master():
    from tidemark.session import scratch_root

    with pytest.raises(RuntimeError):
        scratch_root("spark://host:7077", None)
    with pytest.raises(RuntimeError):
        scratch_root("local-cluster[2,1,1024]", None)
    assert scratch_root("yarn", "hdfs:///shared") == "hdfs:///shared" and scratch_root("local[4]", None)
