"""Aggregates over trailing row frames, on arrays: a step of a frame is one array operation over all rows of a series.

Spark's sliding frames aggregate every frame anew, row by row. Here Spark deals and sorts the rows as for a window, and the frames of
all rows of an Arrow batch take their first value, then their second, and so on, in the order and by the formulas of Spark's own
aggregates: nulls take no part, NaN is the largest value. The last rows of a batch go along with the next one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import Axis

#: numbers that lie in memory at a time where frames are laid out
_NUMBERS_AT_ONCE = 4_000_000


class Frame(NamedTuple):
    """An aggregate of the last ``n`` rows; null until the frame holds ``least`` values of ``gate`` (the input if not given, ``*``: rows)."""

    kind: str
    inputs: str | tuple[str, ...]
    n: int
    least: int = 1
    share: float = 0.5
    gate: str | None = None

    def names(self) -> tuple[str, ...]:
        return (self.inputs,) if isinstance(self.inputs, str) else self.inputs


class Rows(NamedTuple):
    """Values of a column (0 if null), where there are any, and the position of each row in its series."""

    x: np.ndarray
    known: np.ndarray
    at: np.ndarray

    def steps(self, n: int):
        """The first, second, ... row of every row's frame, and whether it is there and known."""
        rows = len(self.x)
        x, known = (np.concatenate([np.zeros(n - 1, a.dtype), a]) for a in (self.x, self.known))
        for k in range(max(n - rows, 0), n):
            there = known[k : k + rows]
            yield x[k : k + rows], there if k == n - 1 else there & (self.at >= n - 1 - k)

    def counts(self, n: int) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(self.known)])
        end = np.arange(1, len(self.x) + 1)
        return before[1:] - before[np.maximum(end - np.minimum(self.at + 1, n), 0)]


def sums(rows: Rows, n: int) -> np.ndarray:
    out = np.zeros(len(rows.x))
    for v, k in rows.steps(n):
        out += np.where(k, v, 0.0)
    return out


def moments(rows: Rows, n: int) -> np.ndarray:
    """Sum of squared deviations of each frame."""
    seen, mean, squares = (np.zeros(len(rows.x)) for _ in range(3))
    for v, k in rows.steps(n):
        seen += k
        delta = np.where(k, v - mean, 0.0)
        part = delta / np.maximum(seen, 1.0)
        mean += part
        squares += delta * (delta - part)
    return squares


def comoments(a: Rows, b: Rows, n: int) -> np.ndarray:
    """Sum of products of deviations of each frame; both sides are known in the same rows."""
    seen, mean_x, mean_y, products = (np.zeros(len(a.x)) for _ in range(4))
    for (u, k), (v, _) in zip(a.steps(n), b.steps(n), strict=True):
        seen += k
        least = np.maximum(seen, 1.0)
        dx, dy = np.where(k, u - mean_x, 0.0), np.where(k, v - mean_y, 0.0)
        mean_x += dx / least
        mean_y += dy / least
        products += dx * np.where(k, v - mean_y, 0.0)
    return products


def quantiles(rows: Rows, n: int, share: float) -> np.ndarray:
    """Interpolated quantile of each frame's values."""
    out = np.empty(len(rows.x))
    laid = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), np.where(rows.known, rows.x, np.nan)]), n)
    place = share * np.maximum(rows.counts(n) - 1, 0)
    back, step = np.arange(n - 1, -1, -1), max(_NUMBERS_AT_ONCE // n, 1)
    for lo in range(0, len(out), step):
        p = place[lo : lo + step]
        low, high, at = np.floor(p).astype(int), np.ceil(p).astype(int), np.arange(len(p))
        ranked = np.sort(np.where(rows.at[lo : lo + step, None] >= back, laid[lo : lo + step], np.nan), axis=1)
        a, b = ranked[at, low], ranked[at, high]
        out[lo : lo + step] = np.where((a == b) | (low == high), a, (high - p) * a + (p - low) * b)
    return out


def weighted(rows: Rows, n: int) -> np.ndarray:
    """Sum of each frame's values times their place (1 the oldest); for frames without gaps."""
    out = np.zeros(len(rows.x))
    for place, (v, k) in enumerate(rows.steps(n), 1 + max(n - len(rows.x), 0)):
        out += np.where(k, v * place, 0.0)
    return out


def deviations(rows: Rows, n: int) -> np.ndarray:
    """Sum of absolute deviations from each frame's mean."""
    mean, out = sums(rows, n) / np.maximum(rows.counts(n), 1), np.zeros(len(rows.x))
    for v, k in rows.steps(n):
        out += np.where(k, np.abs(v - mean), 0.0)
    return out


def before(rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The value ``k`` rows earlier, and where there is one."""
    x, known = (np.concatenate([np.zeros(k, a.dtype), a])[: len(a)] for a in (rows.x, rows.known))
    return x, known & (rows.at >= k)


def shares_below(rows: Rows, n: int) -> np.ndarray:
    """Share of each frame's rows that lie strictly below its last value; null rows stay in the denominator."""
    below, odd = np.zeros(len(rows.x)), np.isnan(rows.x)
    for v, k in rows.steps(n):
        below += k & ((v < rows.x) | (odd & ~np.isnan(v)))
    return below / np.minimum(rows.at + 1, n)


def _aggregate(f: Frame, columns: Mapping[str, Rows]) -> tuple[np.ndarray, np.ndarray]:
    """Values of a frame, and where there are any."""
    rows, n = columns[f.names()[0]], f.n
    if len(f.names()) == 2:
        other = columns[f.names()[1]]
        both = rows.known & other.known
        rows, other = rows._replace(known=both), other._replace(known=both)
    held = rows.counts(n)
    some = np.maximum(held, 1)
    enough = held >= 1
    if f.kind == "sum":
        out = sums(rows, n)
    elif f.kind == "mean":
        out = sums(rows, n) / some
    elif f.kind == "min":
        out = np.full(len(held), np.nan)
        for v, k in rows.steps(n):
            out = np.fmin(out, np.where(k, v, np.nan))
    elif f.kind == "max":
        out = np.full(len(held), -np.inf)
        for v, k in rows.steps(n):
            out = np.maximum(out, np.where(k, v, -np.inf))
    elif f.kind in ("var_samp", "std_samp"):
        out, enough = moments(rows, n) / np.maximum(some - 1, 1), held >= 2
        out = np.sqrt(out) if f.kind == "std_samp" else out
    elif f.kind == "var_pop":
        out = moments(rows, n) / some
    elif f.kind == "covar_samp":
        out, enough = comoments(rows, other, n) / np.maximum(some - 1, 1), held >= 2
    elif f.kind == "covar_pop":
        out = comoments(rows, other, n) / some
    elif f.kind == "corr":
        spread = np.sqrt(moments(rows, n) / some) * np.sqrt(moments(other, n) / some)
        out, enough = comoments(rows, other, n) / some / np.where(spread == 0, 1.0, spread), enough & (spread != 0)
    elif f.kind == "quantile":
        out = quantiles(rows, n, f.share)
    elif f.kind == "share_below":
        out, enough = shares_below(rows, n), rows.known
    elif f.kind == "weighted":
        out, enough = weighted(rows, n) / (n * (n + 1) / 2.0), held >= n
    elif f.kind == "mean_abs_dev":
        out = deviations(rows, n) / n
    elif f.kind == "first":  # the value of the frame's first row, whatever the rows behind it hold
        return before(rows, n - 1)
    else:
        raise ValueError(f"no aggregate {f.kind}")
    gate = held if f.gate is None else np.minimum(rows.at + 1, n) if f.gate == "*" else columns[f.gate].counts(n)
    return out, enough & (gate >= f.least)


def framed(df: DataFrame, outputs: Mapping[str, Frame], axis: Axis) -> DataFrame:
    """Add a double column per frame. Call it inside ``windowed``, whose blocks fit a task: rows are dealt and sorted by the axis as they are."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in outputs], *[T.StructField(n, T.DoubleType()) for n in outputs]])
    columns, longest = [f.name for f in schema.fields], max(f.n for f in outputs.values())
    read = list(dict.fromkeys(c for f in outputs.values() for c in [*f.names(), f.gate] if c not in (None, "*")))

    def column(rows: pa.Table, name: str, at: np.ndarray) -> Rows:
        values = pc.cast(rows[name].combine_chunks(), pa.float64(), safe=False)
        return Rows(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False), at)

    def run(batches):
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            ahead = 0 if last is None or rows["_at"][0].as_py() == 1 else len(last)
            seen = pa.concat_tables([last, rows.select([*read, "_at"])]) if ahead else rows.select([*read, "_at"])
            at = seen["_at"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) - 1
            found = {c: column(seen, c, at) for c in read}
            made = dict(zip(rows.column_names, rows.columns, strict=True))
            with np.errstate(all="ignore"):
                for name, f in outputs.items():
                    values, enough = _aggregate(f, found)
                    made[name] = pa.array(values[ahead:], mask=~enough[ahead:], type=pa.float64(), from_pandas=False)
            last = seen.slice(max(len(seen) - longest + 1, 0))
            yield from pa.table({c: made[c] for c in columns}).combine_chunks().to_batches()

    # the window puts the rows of a series behind one another, in their order
    return df.withColumn("_at", F.row_number().over(axis.spec())).mapInArrow(run, schema)


class Frames(NamedTuple):
    """Columns that frames read, the frames, and the columns made from them."""

    frames: Mapping[str, Frame]
    outputs: Mapping[str, Column]
    inputs: Mapping[str, Column] = {}


def with_frames(df: DataFrame, axis: Axis, *parts: Frames) -> DataFrame:
    """Add the outputs of all parts; their frames share one pass, inputs and frames are dropped."""
    inputs, frames, outputs = (reduce(lambda x, y: {**x, **y}, [getattr(p, kind) for p in parts], {}) for kind in ("inputs", "frames", "outputs"))
    return framed(df.withColumns(inputs), frames, axis).withColumns(outputs).drop(*[c for c in (*inputs, *frames) if c not in outputs])
