"""Several ordered steps over the rows of each series in one pass, behind one exchange.

Spark does not know how rows are dealt once a function has seen them, so every window or recurrence behind another one deals and sorts all
columns made so far anew. Here the rows are dealt and sorted once, with the few columns that the steps read. The steps (exponential means,
trailing frames, arithmetic between them) then follow each other on the Arrow batches of a task; a series that runs over the end of a batch
carries the state of its steps into the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.frames import Frame, Frames, Rows, _aggregate
from tidemark.operators.recurrences import std_with_state
from tidemark.operators.series import Axis, has_hot_key, scan, windowed

#: rows that the steps take at a time, at least
_ROWS_AT_ONCE = 32_768


class Values(NamedTuple):
    """A column of the rows at hand: NaN where nothing is known, as are values that are NaN themselves."""

    x: np.ndarray
    known: np.ndarray


class Means(NamedTuple):
    """Exponential means ``{name: (column, alpha, least values)}``; the rules of ``recurrences.ewm_mean``."""

    outputs: Mapping[str, tuple[str, float, int]]

    def reads(self) -> list[str]:
        return [c for c, _, _ in self.outputs.values()]

    def names(self) -> list[str]:
        return list(self.outputs)

    def width(self) -> int:
        """Numbers of its state: last mean, rows since the last value, values seen, of each mean."""
        return 3 * len(self.outputs)

    def run(self, columns: Mapping[str, Values], at: np.ndarray, state: np.ndarray | None):
        n, first = len(at), np.flatnonzero(at == 0)
        fresh, last = state is None, int(first[-1]) if len(first) else 0
        carried = np.tile([np.nan, 0.0, 0.0], len(self.outputs)) if fresh else state
        made, after = {}, np.empty(self.width())
        for alpha in dict.fromkeys(a for _, a, _ in self.outputs.values()):
            names = [k for k, (_, a, _) in self.outputs.items() if a == alpha]
            spots = [3 * list(self.outputs).index(k) for k in names]
            # the mean so far is one more value in front; beyond this many rows it has no weight left
            fade = ceil(750.0 / -log(1.0 - alpha)) if alpha < 1 else 1
            gaps = [int(min(carried[s + 1], fade)) if not np.isnan(carried[s]) else -1 for s in spots]
            lead = max(gaps) + 1
            laid = np.full((lead + n, len(names)), np.nan)
            for j, (k, s) in enumerate(zip(names, spots, strict=True)):
                if gaps[j] >= 0:
                    laid[lead - 1 - gaps[j], j] = carried[s]
                laid[lead:, j] = columns[self.outputs[k][0]].x
            series = np.concatenate([np.zeros(lead, dtype=np.int64), np.cumsum(at == 0)])
            means = pd.DataFrame(laid).groupby(series, sort=False).ewm(alpha=alpha, adjust=False).mean().to_numpy()[lead:]
            for j, (k, s) in enumerate(zip(names, spots, strict=True)):
                valid = ~np.isnan(laid[lead:, j])
                so_far = np.cumsum(valid)
                base = np.zeros(n)
                if len(first):
                    base[first[0] :] = np.repeat(so_far[first] - valid[first], np.diff([*first, n]))
                counts = so_far - base
                counts[: first[0] if len(first) else n] += carried[s + 2]
                made[k] = np.where(counts >= max(self.outputs[k][2], 1), means[:, j], np.nan)
                hits = np.flatnonzero(valid[last:])
                gap = n - 1 - last - hits[-1] if len(hits) else n - last + (0.0 if len(first) else carried[s + 1])
                after[s : s + 3] = means[-1, j], gap, counts[-1]
        return {k: Values(v, ~np.isnan(v)) for k, v in made.items()}, after


class Trailing(NamedTuple):
    """Aggregates of trailing frames, ``{name: frame}``."""

    frames: Mapping[str, Frame]

    def reads(self) -> list[str]:
        return list(dict.fromkeys(c for f in self.frames.values() for c in [*f.names(), f.gate] if c not in (None, "*")))

    def names(self) -> list[str]:
        return list(self.frames)

    def back(self) -> int:
        return max(f.n for f in self.frames.values()) - 1

    def width(self) -> int:
        """Numbers of its state: the last rows of each column it reads, and which of them are known."""
        return 2 * self.back() * len(self.reads())

    def run(self, columns: Mapping[str, Values], at: np.ndarray, state: np.ndarray | None):
        back, reads = self.back(), self.reads()
        behind = state.reshape(2, len(reads), back) if state is not None else np.stack([np.zeros((len(reads), back))] * 2)
        places = np.concatenate([np.zeros(back, dtype=at.dtype), at])
        seen, after = {}, np.empty((2, len(reads), back))
        for i, c in enumerate(reads):
            known = np.concatenate([behind[1, i] > 0, columns[c].known])
            x = np.concatenate([behind[0, i], columns[c].x])
            seen[c] = Rows(np.where(known, x, 0.0), known, places)
            after[0, i], after[1, i] = (a[len(a) - back :] for a in (seen[c].x, known))
        made = {}
        for name, f in self.frames.items():
            values, enough = _aggregate(f, seen)
            made[name] = Values(np.where(enough, values, np.nan)[back:], enough[back:])
        return made, after.reshape(-1)


class Made(NamedTuple):
    """Arithmetic on columns that are there, ``{name: function of their arrays}``; NaN is null."""

    columns: Mapping[str, Callable[[Mapping[str, np.ndarray]], np.ndarray]]
    inputs: tuple[str, ...]

    def reads(self) -> list[str]:
        return list(self.inputs)

    def names(self) -> list[str]:
        return list(self.columns)

    def width(self) -> int:
        return 0

    def run(self, columns: Mapping[str, Values], at: np.ndarray, state: np.ndarray | None):
        x = {c: columns[c].x for c in self.inputs}
        made = {name: make(x) for name, make in self.columns.items()}
        return {k: Values(v, ~np.isnan(v)) for k, v in made.items()}, np.empty(0)


class Deviations(NamedTuple):
    """Exponentially weighted deviations ``{name: (column, alpha, least values)}``; the rules of ``recurrences.ewm_std``."""

    outputs: Mapping[str, tuple[str, float, int]]

    def reads(self) -> list[str]:
        return [c for c, _, _ in self.outputs.values()]

    def names(self) -> list[str]:
        return list(self.outputs)

    def width(self) -> int:
        return 6 * len(self.outputs)

    def run(self, columns: Mapping[str, Values], at: np.ndarray, state: np.ndarray | None):
        cuts = sorted({0, *np.flatnonzero(at == 0).tolist(), len(at)})
        made, after = {}, []
        for i, (name, (source, alpha, least)) in enumerate(self.outputs.items()):
            found, carry = [], None if state is None else tuple(state[6 * i : 6 * i + 6])
            for a, z in zip(cuts, cuts[1:]):
                values, carry = std_with_state(columns[source].x[a:z], alpha, least, None if at[a] == 0 else carry)
                found.append(values)
            values = np.concatenate(found)
            made[name] = Values(values, ~np.isnan(values))
            after += carry
        return made, np.array(after, dtype=float)


Step = Means | Trailing | Made | Deviations


def over(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Division whose zero denominator gives null."""
    return num / np.where(den == 0, np.nan, den)


def where(holds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Null where the condition does not hold."""
    return np.where(holds, x, np.nan)


def _follow(steps: Sequence[Step], columns: Mapping[str, Values], at: np.ndarray, state: np.ndarray | None):
    """What the steps add, and the state of the last series behind the last row; ``state`` is that of the first one."""
    columns, after, used = dict(columns), [], 0
    with np.errstate(all="ignore"):
        for step in steps:
            made, carry = step.run(columns, at, None if state is None else state[used : used + step.width()])
            used += step.width()
            columns |= made
            after.append(carry)
    return columns, np.concatenate(after)


def _values(rows: pa.Table, name: str) -> Values:
    column = rows[name].combine_chunks()
    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return Values(pc.fill_null(pc.cast(column, pa.float64(), safe=False), float("nan")).to_numpy(zero_copy_only=False), known)


def ordered(df: DataFrame, steps: Sequence[Step], axis: Axis, keep: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the rows and ``added``, made by the steps as doubles."""
    made = [n for s in steps for n in s.names()]
    reads = [c for c in dict.fromkeys(c for s in steps for c in s.reads()) if c not in made]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in added]])
    df = df.select(*dict.fromkeys([*keep, *reads]))

    if has_hot_key(df, axis):
        # blocks of a hot key: the state is a list of numbers, the first of which counts the rows before
        def step(pdf, state):
            state = None if state is None else np.array(state, dtype=float)
            at = np.arange(len(pdf)) + (0 if state is None else int(state[0]))
            found = {c: pdf[c].to_numpy(dtype=float) for c in reads}
            columns, after = _follow(steps, {c: Values(x, ~np.isnan(x)) for c, x in found.items()}, at, None if state is None else state[1:])
            return {c: columns[c].x for c in added}, [float(at[-1] + 1), *after.tolist()]

        return scan(df, step, T.StructType(schema.fields[len(keep) :]), axis).select(*keep, *added)

    at_once = _ROWS_AT_ONCE

    def run(batches: Iterable[pa.RecordBatch]):
        state = None
        for rows in _gathered(batches, at_once):
            at = rows["_at"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) - 1
            columns, state = _follow(steps, {c: _values(rows, c) for c in reads}, at, None if at[0] == 0 else state)
            new = [pa.array(columns[c].x, mask=~columns[c].known, type=pa.float64(), from_pandas=False) for c in added]
            yield from pa.table([*[rows[c] for c in keep], *new], names=[*keep, *added]).combine_chunks().to_batches()

    # the window puts the rows of a series behind one another, in their order
    return df.withColumn("_at", F.row_number().over(axis.spec())).mapInArrow(run, schema)


def _gathered(batches: Iterable[pa.RecordBatch], at_once: int):
    """Tables of at least so many rows (the last one may be shorter)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= at_once:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


class Part(NamedTuple):
    """An indicator: columns of a row and its neighbours, the ordered steps on them, and what is made of those. Names with an underscore are dropped."""

    inputs: Callable[[Axis], Mapping[str, Column]]
    steps: Sequence[Step]
    outputs: Mapping[str, Column] = {}
    lookback: int = 1  # rows that an input looks back


def of_frames(*parts: Frames) -> Part:
    """The frames of all parts in one step; see ``frames.with_frames``."""
    inputs, frames, outputs = (reduce(lambda x, y: {**x, **y}, [getattr(p, kind) for p in parts], {}) for kind in ("inputs", "frames", "outputs"))
    return Part(lambda a: inputs, [Trailing(frames)], outputs)


def with_parts(df: DataFrame, axis: Axis, *parts: Part, keep: Sequence[str] | None = None) -> DataFrame:
    """Add what the parts make, all in one pass; ``keep`` names the columns that stay (all, if not given)."""

    def add(d: DataFrame, a: Axis) -> DataFrame:
        return d.withColumns({k: c for p in parts for k, c in p.inputs(a).items()})

    keep = df.columns if keep is None else list(keep)
    df = windowed(df, add, axis, lookback=max(p.lookback for p in parts))
    steps = [s for p in parts for s in p.steps]
    added = list(dict.fromkeys(n for s in steps for n in s.names()))
    inputs = [c for c in df.columns if c not in keep and c not in added and any(c in p.inputs(axis) for p in parts)]
    shown = [c for c in inputs if not c.startswith("_")]
    out = ordered(df, steps, axis, [c for c in [*keep, *shown] if c not in added], added)
    out = out.withColumns({k: c for p in parts for k, c in p.outputs.items()})
    return out.drop(*[c for c in added if c.startswith("_")])
