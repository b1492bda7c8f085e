"""Exits of bracket trades: the series path gives what the look-ahead window gives, and carries no bars along."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import spark_rows

import __spark_entry__ as entry
from tidemark.operators import backtest as bt
from tidemark.operators.series import BARS


@pytest.fixture()
def tables(spark):
    rng = np.random.default_rng(8)
    bars, entries = [], []
    for key, n in (("a", 90), ("b", 7), ("c", 1), (None, 12)):
        for i in range(n):
            price = 100 + float(rng.normal())
            hole = lambda v: None if rng.random() < 0.1 else v  # noqa: B023, E731
            bars.append((key, i, i, hole(price + 1), hole(price - 1), hole(price)))
            if rng.random() < 0.6 or i == n - 1:
                for direction in rng.choice(np.array(["long", "short", None], dtype=object), rng.integers(1, 3)):
                    entries.append((key, i, direction, price, hole(price + float(rng.normal(0, 2))), hole(price + float(rng.normal(0, 2)))))
    entries += [("a", 500, "long", 1.0, 1.0, 1.0), ("a", None, "long", 1.0, 1.0, 1.0), ("z", 0, "long", 1.0, 1.0, 1.0)]
    return (spark.createDataFrame(entries, "symbol string, rn long, direction string, entry_price double, stop_price double, target_price double"),
            spark.createDataFrame(bars, "symbol string, ts int, rn long, high double, low double, close double"))


@pytest.mark.parametrize("most", [0, 1, 5, 200])
def test_both_paths_find_the_same_exits(tables, most):
    found, wanted = spark_rows(bt._exits_by_series(*tables, most, BARS)), spark_rows(bt._exits_by_window(*tables, most, BARS))
    assert found == wanted and len(found[1]) > 60


@pytest.mark.parametrize("name", ["first_touch_exits", "one_open_trade", "trade_summary"])
def test_no_bar_carries_its_next_bars(spark, folder, name):
    """the next 20 bars of every bar were dealt to a join."""
    text = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "CoGroupsInArrow" in text
