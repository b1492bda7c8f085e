"""Exponential means and other linear recurrences on the ``scan`` primitive."""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.series import BARS, Axis, scan


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: int) -> float:
    return 1.0 / n


def _mean_with_state(x: pd.Series, alpha: float, least: int, state):
    """One exponential mean; state = (last mean, nulls since the last value, values seen)."""
    last, gap, seen = state if state is not None else (np.nan, 0.0, 0.0)
    lead = []
    if not np.isnan(last):
        fade = ceil(750.0 / -log(1.0 - alpha)) if alpha < 1 else 1
        lead = [last] + [np.nan] * int(min(gap, fade))
    y = pd.Series(np.concatenate([lead, x.to_numpy(dtype=float)])).ewm(alpha=alpha, adjust=False).mean()
    y = y.to_numpy()[len(lead):]
    valid = x.notna().to_numpy()
    counts = seen + np.cumsum(valid)
    hits = np.flatnonzero(valid)
    gap = float(len(x) - 1 - hits[-1]) if len(hits) else gap + len(x)
    out = np.where(counts >= max(least, 1), y, np.nan)
    return out, (float(y[-1]), float(gap), float(counts[-1]))


def ewm_mean(df: DataFrame, outputs: Mapping[str, tuple[str, float, int]], axis: Axis = BARS) -> DataFrame:
    """Add exponential means ``{name: (column, alpha, least values)}`` in one ordered pass.

    The first value starts the mean, nulls age the previous weight, and the result is null until
    ``least`` values were seen.
    """
    items = list(outputs.items())

    def step(pdf, state):
        cols, carry = {}, []
        for i, (name, (source, alpha, least)) in enumerate(items):
            old = tuple(state[3 * i : 3 * i + 3]) if state is not None else None
            values, new = _mean_with_state(pdf[source].astype(float), alpha, least, old)
            cols[name] = values
            carry += list(new)
        return cols, carry

    return scan(df, step, ", ".join(f"{n} double" for n, _ in items), axis, needs=list(dict.fromkeys(source for source, _, _ in outputs.values())))


def std_with_state(x: np.ndarray, alpha: float, least: int, state) -> tuple[np.ndarray, list[float]]:
    """One exponentially weighted deviation; the state keeps the weighted mean and variance and the sums of weights and squared weights."""
    keep = 1.0 - alpha
    mean, var, s1, s2, old, seen = state if state is not None else (np.nan, 0.0, 1.0, 1.0, 1.0, 0.0)
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        if np.isnan(mean):
            if not np.isnan(v):
                mean, seen = v, 1.0
        else:
            s1, s2, old = s1 * keep, s2 * keep * keep, old * keep
            if not np.isnan(v):
                share = alpha / (old + alpha)
                shift = v - mean
                moved = mean + share * shift
                var = (1 - share) * (var + (mean - moved) ** 2) + share * (v - moved) ** 2
                mean = moved
                s1, s2 = (s1 + alpha) / (old + alpha), (s2 + alpha * alpha) / (old + alpha) ** 2
                old, seen = 1.0, seen + 1
        spread = s1 * s1 - s2
        if seen >= least and spread > 0:
            out[i] = np.sqrt(max(var, 0.0) * s1 * s1 / spread)
    return out, [mean, var, s1, s2, old, seen]


def ewm_std(df: DataFrame, name: str, source: str, alpha: float, least: int, axis: Axis = BARS) -> DataFrame:
    """Exponentially weighted standard deviation with the finite-sample bias correction."""

    def step(pdf, state):
        values, after = std_with_state(pdf[source].to_numpy(dtype=float), alpha, least, state)
        return {name: values}, after

    return scan(df, step, f"{name} double", axis, needs=[source])


def decayed_sum(
    df: DataFrame, name: str, source: str, decay: float, gain: float = 1.0, axis: Axis = BARS, initial: float = 0.0
) -> DataFrame:
    """y[t] = decay * y[t-1] + gain * x[t] (null x counts as 0)."""

    def step(pdf, state):
        level = state[0] if state is not None else initial
        x = gain * pdf[source].fillna(0).to_numpy(dtype=float)
        # a sum with weights decay ** age, the level before the rows being one more value
        out = pd.Series(np.concatenate([[level], x])).ewm(alpha=1 - decay, adjust=True).sum().to_numpy()[1:]
        return {name: out}, [float(out[-1])]

    return scan(df, step, f"{name} double", axis, needs=[source])
