"""Fractal and spectral statistics of a series.

Segments and windows are exploded to rows and grouped, so a task only ever holds one segment.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.series import BARS, Axis, arrow_column, has_hot_key, in_order, positions
from tidemark.operators.tables import with_group_size


def log_windows(n: Column, least: int = 4, count: int = 20) -> Column:
    """Distinct integer window lengths, log-spaced from ``least`` to n/2."""
    top = F.floor(n / 2)
    step = (F.log10(top) - F.log10(F.lit(float(least)))) / (count - 1)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        # the small offset keeps exact powers on their own integer
        lambda i: F.floor(F.pow(F.lit(10.0), F.log10(F.lit(float(least))) + i * step) + 1e-9).cast("int"),
    )
    return F.when(top >= least, F.filter(F.array_distinct(raw), lambda w: w >= least))


def _slope(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least-squares slope of log y on log x per row over its positive y; NaN below two of them."""
    with np.errstate(all="ignore"):
        use = ~np.isnan(y) & ~(y <= 0)
        n = use.sum(1)
        lx = np.where(use, np.log(x), 0.0)
        ly = np.where(use, np.log(np.where(use, y, 1.0)), 0.0)
        dx = np.where(use, lx - (lx.sum(1) / n)[:, None], 0.0)
        slope = (dx * ly).sum(1) / (dx * dx).sum(1)
    return np.where(n >= 2, slope, np.nan)


def _exponents(x: np.ndarray, least: int, count: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Both exponents of each row of ``x``, over the windows of ``log_windows``; None if there is no window."""
    rows, n = x.shape
    if n // 2 < least:
        return None
    step = (np.log10(n // 2) - np.log10(least)) / (count - 1)
    sizes = np.unique(np.floor(10.0 ** (np.log10(least) + np.arange(count) * step) + 1e-9).astype(int))
    sizes = sizes[sizes >= least]
    rs, fl = np.full((rows, len(sizes)), np.nan), np.full((rows, len(sizes)), np.nan)
    with np.errstate(all="ignore"):
        for i, w in enumerate(sizes):
            seg = x[:, : n // w * w].reshape(rows, n // w, w)
            seg = seg - seg[:, :, :1]  # equal values have no spread at all
            off = seg - seg.mean(2, keepdims=True)
            walk, syy, t = off.cumsum(2), (off * off).sum(2), np.arange(w) - (w - 1) / 2
            sd, sxy = np.sqrt(syy / (w - 1)), off @ t
            ratio = np.where(sd <= 0, np.nan, (walk.max(2) - walk.min(2)) / sd)
            some = (~(sd <= 0)).sum(1)
            rs[:, i] = np.where(some > 0, np.where(sd <= 0, 0.0, ratio).sum(1) / some, np.nan)
            fl[:, i] = np.sqrt(np.maximum(syy - sxy * sxy / (t @ t), 0.0) / w).mean(1)
    return _slope(rs, sizes), _slope(fl, sizes)


def _per_series(df: DataFrame, value: str, axis: Axis, extra: str, made) -> DataFrame:
    """``made(values)`` of each series in its order: a dict of columns ``extra`` next to the keys; a series fits a task."""
    keys, order = list(axis.keys), list(axis.order)
    schema = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(extra).fields])

    def run(rows: pa.Table) -> pa.Table:
        found = made(in_order(rows, order, axis.descending)[value].to_numpy().astype(float))
        size = len(next(iter(found.values())))
        own = {k: rows[k].take(pa.array([0] * size, pa.int64())) for k in keys}
        return pa.table(own | {f.name: arrow_column(found[f.name], f.dataType) for f in schema.fields[len(keys):]})

    return df.select(*keys, *[c for c in order if c not in keys], value).groupBy(*keys).applyInArrow(run, schema)


def fractal(df: DataFrame, value: str, keys: Sequence[str], axis: Axis | None = None, least: int = 4, count: int = 20, numbered: bool = False) -> DataFrame:
    """Per key: rescaled-range and detrended-fluctuation exponents and the dimensions 2 − H.

    The fluctuation analysis detrends the values themselves, not their cumulative profile. ``numbered``
    says that ``rn`` and ``n`` are already there. A series that fits a task is cut into its segments there; the rows of longer ones
    are exploded into segments that meet by key.
    """
    keys = list(keys)
    if not numbered:
        df, axis = df.where(F.col(value).isNotNull()), axis or Axis(tuple(keys))
        if not has_hot_key(df, axis):

            def made(x: np.ndarray) -> dict:
                found = _exponents(x[None, :], least, count) or (np.empty(0), np.empty(0))
                return {"hurst_rs": found[0], "hurst_dfa": found[1]}

            return _dimensions(_per_series(df, value, axis, "hurst_rs double, hurst_dfa double", made))
        df = with_group_size(positions(df, axis), keys, "n")
    rows = df.select(*keys, "rn", "n", F.col(value).alias("x"), F.explode(log_windows(F.col("n"), least, count)).alias("w"))
    rows = rows.withColumn("seg", F.floor(F.col("rn") / F.col("w"))).where(F.col("seg") < F.floor(F.col("n") / F.col("w")))
    part = Window.partitionBy(*keys, "w", "seg")
    walk = part.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", F.avg("x").over(part)).withColumn("cum", F.sum(F.col("x") - F.col("_m")).over(walk))
    t = (F.col("rn") - F.col("seg") * F.col("w")).cast("double")
    segs = rows.groupBy(*keys, "w", "seg").agg(
        (F.max("cum") - F.min("cum")).alias("r"), F.stddev_samp("x").alias("s"), F.count(F.lit(1)).alias("k"),
        F.regr_syy("x", t).alias("syy"), F.regr_sxy("x", t).alias("sxy"), F.regr_sxx("x", t).alias("sxx"),
    )
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    per = segs.groupBy(*keys, "w").agg(
        F.avg(F.when(F.col("s") > 0, F.col("r") / F.col("s"))).alias("rs"), F.avg(F.sqrt(left / F.col("k"))).alias("fl")
    )
    lw = F.log(F.col("w").cast("double"))
    ok = lambda c: F.when(F.col(c) > 0, F.log(c))
    # slopes need at least two usable window lengths
    slope = lambda c: F.when(F.count(ok(c)) >= 2, F.regr_slope(ok(c), lw))
    h = per.groupBy(*keys).agg(slope("rs").alias("hurst_rs"), slope("fl").alias("hurst_dfa"))
    return _dimensions(h)


def _dimensions(h: DataFrame) -> DataFrame:
    return h.withColumns({"fd_rs": 2 - F.col("hurst_rs"), "fd_dfa": 2 - F.col("hurst_dfa")})


#: values of overlapping windows held at a time
WINDOW_VALUES = 1_000_000


def _window_end(w: int):
    return lambda e: F.struct(F.lit(w).alias("window"), e.alias("end_rn"))


def rolling_fractal(df: DataFrame, value: str, windows: Sequence[int], stride: int = 5, axis: Axis = BARS) -> DataFrame:
    """Fractal statistics of trailing windows ending every ``stride`` rows: (keys, end_rn, window, ...)."""
    keys = list(axis.keys)
    df = df.where(F.col(value).isNotNull())
    if not has_hot_key(df, axis):

        def made(x: np.ndarray) -> dict:
            out = {c: [] for c in ("window", "end_rn", "hurst_rs", "hurst_dfa")}
            for w in windows:
                ends = np.arange(stride - 1, len(x), stride)
                ends = ends[ends >= w - 1]
                # some windows at a time, so that their copies stay small
                for lo in range(0, len(ends), max(WINDOW_VALUES // w, 1)):
                    some = ends[lo : lo + max(WINDOW_VALUES // w, 1)]
                    found = _exponents(np.lib.stride_tricks.sliding_window_view(x, w)[some - w + 1], 4, 20)
                    if found is not None:
                        for c, v in zip(out, (np.full(len(some), w), some, *found), strict=True):
                            out[c].append(v)
            return {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}

        return _dimensions(_per_series(df, value, axis, "window int, end_rn bigint, hurst_rs double, hurst_dfa double", made))
    df = with_group_size(positions(df, axis, "p"), keys, "total", axis.hot)
    parts = []
    for w in windows:
        # ends e with e >= p, e < p + w, (e + 1) % stride == 0 and a full window
        first = F.greatest(F.ceil((F.col("p") + 1) / stride) * stride - 1, F.ceil(F.lit(w) / stride) * stride - 1)
        last = F.least(F.col("p") + w - 1, F.col("total") - 1)
        ends = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long")))
        parts.append(F.transform(ends, _window_end(w)))
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<window:int,end_rn:bigint>>")) for p in parts]))
    rows = df.select(*keys, "p", F.col(value), F.explode(every).alias("_w")).select(*keys, "p", value, "_w.window", "_w.end_rn")
    rows = rows.withColumns({"rn": F.col("p") - (F.col("end_rn") - F.col("window") + 1), "n": F.col("window")})
    return fractal(rows, value, [*keys, "window", "end_rn"], numbered=True)


def magnitude_spectrum(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Half magnitude spectrum (k, frequency, magnitude) of each demeaned series.

    A transform needs its whole series, so a series is one group here; series longer than a task may
    hold belong into ``welch``, whose segments are bounded.
    """
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("frequency", T.DoubleType()), T.StructField("magnitude", T.DoubleType())])
    order = "rn"

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(dtype=float)
        n, half = len(x), len(x) // 2
        size = np.abs(np.fft.rfft(x - x.mean()))[:half] * 2 / n if half else np.array([])
        out = pd.DataFrame({"k": np.arange(half, dtype="int32"), "frequency": np.arange(half) / max(n, 1), "magnitude": size})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[f.name for f in schema.fields]]

    return positions(df, Axis(tuple(keys))).select(*keys, order, value).groupBy(*keys).applyInPandas(transform, schema)


def welch(df: DataFrame, value: str, keys: Sequence[str], segment: int = 256) -> DataFrame:
    """Power spectral density (k, frequency, psd): Hann window, half overlap, constant detrend, mean over segments."""
    keys = list(keys)
    df = with_group_size(positions(df.where(F.col(value).isNotNull()), Axis(tuple(keys))), keys, "n")
    size = F.least(F.lit(segment), F.col("n"))
    hop = size - F.floor(size / 2)
    count = F.floor((F.col("n") - size) / hop) + 1
    s1 = F.floor(F.col("rn") / hop)
    homes = F.filter(F.array(s1 - 1, s1), lambda s: (s >= 0) & (s < count) & (F.col("rn") < s * hop + size))
    rows = df.select(*keys, "rn", value, F.explode(homes).alias("seg")).where(F.col("n") >= 2)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("frequency", T.DoubleType()), T.StructField("p", T.DoubleType())])

    def density(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("rn")[value].to_numpy(dtype=float)
        n = len(x)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (w * w).sum()
        p[1 : len(p) - 1 if n % 2 == 0 else len(p)] *= 2
        out = pd.DataFrame({"k": np.arange(len(p), dtype="int32"), "frequency": np.arange(len(p)) / n, "p": p})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[f.name for f in schema.fields]]

    parts = rows.groupBy(*keys, "seg").applyInPandas(density, schema)
    return parts.groupBy(*keys, "k", "frequency").agg(F.avg("p").alias("psd"))


def spectral_features(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Spectral entropy, dominant frequency, peak ratio, density mean and maximum, largest FFT magnitude."""
    keys = list(keys)
    psd = welch(df, value, keys)
    psd = psd.withColumn("_total", F.sum("psd").over(Window.partitionBy(*keys)))  # at most segment/2 + 1 rows per key
    share = F.col("psd") / F.col("_total")
    g = psd.groupBy(*keys).agg(
        F.sum(F.when(share > 0, -share * F.log(share))).alias("spectral_entropy"),
        F.max_by("frequency", F.struct("psd", -F.col("k"))).alias("dominant_frequency"),
        (F.max("psd") / F.sum("psd")).alias("peak_ratio"), F.avg("psd").alias("psd_mean"), F.max("psd").alias("psd_max"),
    )
    peak = magnitude_spectrum(df, value, keys).groupBy(*keys).agg(F.max("magnitude").alias("fft_peak_magnitude"))
    return g.join(peak, keys)
