"""Exponentially decayed sums over irregular times, for scalar and vector weights.

A decayed sum is a prefix sum after rescaling: Σ w_j·e^{−r(t_i − t_j)} = e^{−r·t_i} · Σ w_j·e^{r·t_j}. The rescaling restarts
whenever its exponent would leave ``SPAN``, so it cannot overflow and a span of rows costs one ``cumsum``. The sum is also
linear in the level it starts from. With a hot key every block therefore gives its own end level in one pass, the few end levels
of a key are added up in order, and a second pass starts each block from its exact level: two passes, whatever the decay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import BARS, Axis, has_hot_key, join_same, largest_key, number_rows, rows_per_task
from tidemark.session import ensure_checkpoint_dir

#: largest exponent of a rescaled span
SPAN = 300.0
#: numbers held at a time per slice of rows
_NUMBERS_AT_ONCE = 4_000_000
#: numbers in a row that ``spark.tidemark.rowsPerTask`` allows for; wider rows make smaller blocks
_ROW = 8


class Level:
    """What rows leave behind: sums strictly before ``last`` per rate, the weight at ``last``, and that time (NaN before any row)."""

    def __init__(self, rates: int, width: int):
        self.before, self.waiting, self.last = np.zeros((rates, width)), np.zeros(width), np.nan

    def flat(self) -> list[float]:
        return [*self.before.ravel().tolist(), *self.waiting.tolist(), float(self.last)]

    @classmethod
    def of(cls, values: Sequence[float], rates: int, width: int) -> Level:
        found, values = cls(rates, width), np.asarray(values, dtype=float)
        found.before = values[: rates * width].reshape(rates, width).copy()
        found.waiting, found.last = values[rates * width : -1].copy(), float(values[-1])
        return found

    def then(self, own: Level, rates: np.ndarray, each_row: bool) -> Level:
        """The level behind a block that starts here and leaves ``own`` when it starts from nothing."""
        if np.isnan(self.last) or np.isnan(own.last):
            return own if np.isnan(self.last) else self
        out = Level(len(rates), len(self.waiting))
        out.last, out.waiting = own.last, own.waiting
        if own.last > self.last or each_row:
            out.before = own.before + (self.before + self.waiting) * np.exp(-rates * (own.last - self.last))[:, None]
        else:
            out.before, out.waiting = self.before, self.waiting + own.waiting
        return out


def past_sums(t: np.ndarray, w: np.ndarray, rates: np.ndarray, level: Level, each_row: bool = False) -> tuple[np.ndarray, Level]:
    """Decayed sums (rate, row, weight) of the rows before each row, and the level behind all rows.

    ``t`` ascends. Before means at an earlier time; with ``each_row`` also rows above at the same time. Rows without a time
    have an empty past and add nothing.
    """
    known = ~np.isnan(t)
    past = np.zeros((len(rates), *w.shape))
    if not known.any():
        return past, level
    if not known.all():
        past[:, known], level = past_sums(t[known], w[known], rates, level, each_row)
        return past, level
    new = np.ones(len(t), dtype=bool)
    if not each_row:
        new[1:] = t[1:] > t[:-1]
    first = np.flatnonzero(new)
    at, sums = t[first], np.add.reduceat(w, first, axis=0)
    joins = not each_row and at[0] == level.last
    if joins:
        sums[0] = sums[0] + level.waiting
    out = Level(len(rates), w.shape[1])
    out.waiting, out.last = sums[-1], float(at[-1])
    place = np.cumsum(new) - 1
    for i, rate in enumerate(rates):
        found = np.empty_like(sums)
        if np.isnan(level.last):
            carried = np.zeros(w.shape[1])
        else:
            carried = level.before[i] if joins else (level.before[i] + level.waiting) * np.exp(-rate * (at[0] - level.last))
        lo = 0
        while lo < len(at):
            hi = max(int(np.searchsorted(at, at[lo] + SPAN / rate, side="right")), lo + 1) if rate > 0 else len(at)
            scale = np.exp(rate * (at[lo:hi] - at[lo]))[:, None]
            so_far = carried + np.cumsum(sums[lo:hi] * scale, axis=0)
            found[lo] = carried
            found[lo + 1 : hi] = so_far[:-1] / scale[1:]
            if hi < len(at):
                carried = so_far[-1] / scale[-1] * np.exp(-rate * (at[hi] - at[hi - 1]))
            lo = hi
        out.before[i] = found[-1]
        past[i] = found[place]
    return past, out


def decayed_past(
    df: DataFrame, at: str | None, weigh: Callable, rates: Sequence[float] | str, emit: Callable, schema: T.StructType,
    axis: Axis = BARS, width: int = 1, each_row: bool = False,
) -> DataFrame:
    """Rows made from the decayed sums of what precedes each row of a series.

    ``weigh(rows)`` gives the weights of a slice of ordered rows as a matrix of ``width`` columns, ``emit(rows, t, past)`` the
    frame of ``schema`` from their times and sums (rate, row, weight). ``at`` ascends with the axis; ``None`` takes the row's
    position. ``rates`` are numbers, none negative, or the name of a column that is constant in a series (null: no sums, NaN).
    """
    if not isinstance(rates, str) and any(r < 0 for r in rates):
        raise ValueError("a rate of decay is not negative")
    order, descending, count = list(axis.order), axis.descending, 1 if isinstance(rates, str) else len(rates)
    columns, step = schema.fieldNames(), max(_NUMBERS_AT_ONCE // max(width * count, 1), 1)

    def rates_of(pdf) -> np.ndarray:
        return pdf[rates].head(1).to_numpy(dtype=float) if isinstance(rates, str) else np.asarray(rates, dtype=float)

    def arranged(pdf):
        # null times first, as in windows (last in descending order)
        return pdf.sort_values(order, ascending=not descending, kind="mergesort", na_position="last" if descending else "first").reset_index(drop=True)

    def walk(pdf, level, speak):
        pdf, made = arranged(pdf), []
        fixed = rates_of(pdf)
        for lo in range(0, len(pdf), step):
            rows = pdf.iloc[lo : lo + step].reset_index(drop=True)
            if at is not None:
                t = rows[at].to_numpy(dtype=float, na_value=np.nan)
            else:
                t = rows["_rn"].to_numpy(dtype=float) if "_rn" in rows else np.arange(lo, lo + len(rows), dtype=float)
            past, level = past_sums(t, np.asarray(weigh(rows), dtype=float), fixed, level, each_row)
            if speak:
                made.append(emit(rows, t, past)[columns])
        return pd.concat(made, ignore_index=True) if speak else level

    limit = max(rows_per_task(df.sparkSession) * _ROW // max(width * count, _ROW), 1)
    hot = has_hot_key(df, axis)
    if not hot and width * count > _ROW:
        hot = largest_key(df, axis.keys) > limit
    if not hot:
        return df.groupBy(*axis.keys).applyInPandas(lambda pdf: walk(pdf, Level(count, width), True), schema)

    ensure_checkpoint_dir(df.sparkSession)
    on = [*axis.keys, "_block"]
    blocked = number_rows(df, axis, "_rn").withColumn("_block", F.floor(F.col("_rn") / max(limit // 2, 1))).checkpoint()
    key_fields, numbers = [f for f in blocked.schema.fields if f.name in on], T.ArrayType(T.DoubleType())
    names = [f.name for f in key_fields]

    def ends(pdf):
        return pdf[names].head(1).assign(_rates=[rates_of(pdf).tolist()], _level=[walk(pdf, Level(count, width), False).flat()])

    def entries(pdf):
        pdf, level, found = pdf.sort_values("_block"), Level(count, width), []
        for own, speed in zip(pdf["_level"], pdf["_rates"], strict=True):
            found.append(level.flat())
            level = level.then(Level.of(own, count, width), np.asarray(speed, dtype=float), each_row)
        return pdf[names].assign(_level=found)

    left = blocked.groupBy(*on).applyInPandas(ends, T.StructType([*key_fields, T.StructField("_rates", numbers), T.StructField("_level", numbers)]))
    # one row per block of a key
    starts = left.groupBy(*axis.keys).applyInPandas(entries, T.StructType([*key_fields, T.StructField("_level", numbers)]))
    return join_same(blocked, starts, on).groupBy(*on).applyInPandas(lambda pdf: walk(pdf, Level.of(pdf["_level"].iloc[0], count, width), True), schema)
