"""Decayed sums over irregular times against a loop over all pairs, on both paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.decay import Level, decayed_past, past_sums
from tidemark.operators.series import ROWS_PER_TASK, Axis


def by_pairs(t, w, rate, each_row):
    out = np.zeros_like(w)
    for i in range(len(t)):
        for j in range(len(t)):
            if t[j] < t[i] or (each_row and t[j] == t[i] and j < i):
                out[i] += w[j] * np.exp(-rate * (t[i] - t[j]))
    return out


@pytest.mark.parametrize("each_row", [False, True])
@pytest.mark.parametrize("spread", [0.0, 0.4, 30.0, 900.0])
def test_sums_equal_pairs(spread, each_row):
    rng = np.random.default_rng(5)
    t = np.sort(np.round(np.cumsum(rng.exponential(1, 90)) * spread, 0))  # whole numbers: ties
    w, rates = rng.normal(size=(90, 3)), np.array([0.0, 0.03, 1.7])
    past, _ = past_sums(t, w, rates, Level(3, 3), each_row)
    for i, rate in enumerate(rates):
        np.testing.assert_allclose(past[i], by_pairs(t, w, rate, each_row), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("each_row", [False, True])
def test_slices_and_levels_compose(each_row):
    t = np.array([0, 0, 1, 1, 1, 2, 5, 5, 5, 9, 2000.0])
    w, rates = np.arange(1.0, 12.0)[:, None], np.array([0.1, 2.0])
    whole, end = past_sums(t, w, rates, Level(2, 1), each_row)
    for at in range(1, len(t)):
        a, level = past_sums(t[:at], w[:at], rates, Level(2, 1), each_row)
        b, _ = past_sums(t[at:], w[at:], rates, level, each_row)
        np.testing.assert_allclose(np.concatenate([a, b], axis=1), whole, rtol=1e-12)
        _, own = past_sums(t[at:], w[at:], rates, Level(2, 1), each_row)
        np.testing.assert_allclose(level.then(own, rates, each_row).flat(), end.flat(), rtol=1e-12)


def test_rows_without_a_time():
    past, level = past_sums(np.array([np.nan, np.nan, 1.0, 2.0]), np.ones((4, 1)), np.array([0.5]), Level(1, 1))
    assert past[0, :, 0].tolist() == [0.0, 0.0, 0.0, pytest.approx(np.exp(-0.5))]
    assert np.isnan(past_sums(np.array([np.nan]), np.ones((1, 1)), np.array([0.5]), Level(1, 1))[1].last) and level.last == 2.0


def test_a_rate_of_decay_is_not_negative(spark):
    with pytest.raises(ValueError):
        decayed_past(spark.range(1), "id", None, [-1.0], None, T.StructType([]))


ROWS = [("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", None, 9.0), ("a", 4.0, 3.0), ("a", 4.0, None), ("a", 900.0, 1.0), ("a", 901.0, 1.0), (None, 2.0, 5.0), (None, 3.0, 1.0), ("b", 2.0, 1.0)]


@pytest.mark.parametrize("each_row", [False, True])
def test_blocks_equal_one_pass(spark, each_row):
    """Blocks of one or two rows, null keys, null times, ties across block edges, repeated rows and an empty table."""
    df = spark.createDataFrame(ROWS * 2, "symbol string, t double, w double")
    schema = T.StructType([*df.schema.fields, T.StructField("s", T.DoubleType()), T.StructField("q", T.DoubleType())])

    def build(frame):
        found = decayed_past(frame, "t", lambda r: r[["w"]].to_numpy(dtype=float, na_value=0.0), [0.1, 3.0],
                             lambda r, t, past: r.assign(s=past[0, :, 0], q=past[1, :, 0]), schema, Axis(("symbol",), ("t", "w")), each_row=each_row)
        rows = found.select("symbol", "t", "w", F.round("s", 9), F.round("q", 9)).collect()
        return sorted(map(tuple, rows), key=repr)

    plain = build(df)
    assert len(plain) == 2 * len(ROWS) and build(df.where("false")) == []
    for size in ("2", "3", "7"):
        spark.conf.set(ROWS_PER_TASK, size)
        try:
            assert build(df) == plain
        finally:
            spark.conf.unset(ROWS_PER_TASK)
