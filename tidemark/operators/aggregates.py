"""Grouped aggregates and matrix-like summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import correlation, ratio
from tidemark.operators.backtest import compound
from tidemark.operators.series import BARS, Axis, checked, pct_change, prev, running, windowed
from tidemark.operators.tables import last_rows


def grouped_documents(df: DataFrame, by: Sequence[str], seq: str, text: str, articles: int | None = None, chars: int | None = None, sep: str = " ") -> DataFrame:
    """The texts of a group joined in order, whole unless limits are asked for.

    ``articles`` keeps the first texts of a group (filtered per task before the shuffle), ``chars`` ends the joined document.
    A group is meant to be one name and day.
    """
    if articles is not None:
        w = Window.partitionBy(*by).orderBy(seq)
        df = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= articles)
    joined = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("k"), F.coalesce(text, F.lit("")).alias("t")))).alias("_parts"))
    parts = F.col("_parts")
    if chars is not None:
        # an article that would start beyond the limit is left out altogether, separator included
        parts = F.filter(parts, lambda p, i: F.aggregate(F.slice(F.col("_parts"), F.lit(1), i), F.lit(0), lambda n, q: n + F.length(q["t"]) + len(sep)) < chars)
    joined = joined.withColumn("_parts", parts)
    document = F.array_join(F.transform("_parts", lambda p: p["t"]), sep)
    document = document if chars is None else F.substring(document, 1, chars)
    return joined.select(*by, document.alias("document"), F.size("_parts").alias("articles"))


def vector_mean(df: DataFrame, by: Sequence[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean of array columns: averages per position, combined before the shuffle."""
    parts = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return ordered.select(*by, F.transform("_v", lambda p: p["_m"]).alias(out))


def ticker_stats(bars: DataFrame, axis: Axis = BARS, per_year: float = 252.0) -> DataFrame:
    df = windowed(bars, lambda d, a: d.withColumn("ret", pct_change("close", a)), axis, lookback=1)
    ax = checked(df, axis)
    df = running(df, {"_log": ("sum", compound("ret"))}, ax).withColumn("_eq", F.exp("_log"))
    df = running(df, {"_peak": ("max", "_eq")}, ax)
    sd = F.stddev_samp("ret")
    return df.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("bars"),
        (F.avg("ret") * per_year).alias("annual_mean"),
        (sd * F.sqrt(F.lit(per_year))).alias("annual_vol"),
        (F.avg("ret") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(per_year))).alias("sharpe"),
        F.min(F.col("_eq") / F.col("_peak") - 1).alias("max_drawdown"),
        F.avg("volume").alias("mean_volume"),
    )


def sample_skew(c: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def distribution(df: DataFrame, by: Sequence[str], c: str, qs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles (linear interpolation), shape and extremes."""
    q = F.percentile(c, F.array(*[F.lit(x) for x in qs])).alias("_q")
    df = df.groupBy(*by).agg(q, sample_skew(c).alias("skew"), sample_kurtosis(c).alias("kurt"), F.min(c).alias("worst"), F.max(c).alias("best"))
    return df.withColumns({f"q{round(x * 100):02d}": F.col("_q")[i] for i, x in enumerate(qs)}).drop("_q")


def comoments(df: DataFrame, key: str, at: str, value: str, left: Sequence, last: int | None = None) -> DataFrame:
    """Covariance and correlation of the named ``left`` keys (benchmarks, a universe) with every key over shared ``at`` values.

    The caller names the left keys, so a row meets as many rows as there are names, and the result has one row per name and
    key: there is no table of all pairs. ``last`` keeps the newest rows of each key.
    """
    clean = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at"), F.col(value).cast("double").alias("x"))
    if last is not None:
        clean = last_rows(clean, Axis(("k",), ("at",)), last)
    named = clean.where(F.col("k").isin(list(left))).select(F.col("k").alias("left_key"), "at", F.col("x").alias("y"))
    pairs = named.join(clean.withColumnRenamed("k", "right_key"), "at")
    return pairs.groupBy("left_key", "right_key").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("y", "x").alias("cov"), correlation("y", "x").alias("corr"))


def resample(df: DataFrame, by: Sequence[str], unit: str, price: str, ret: str, ts: str = "ts") -> DataFrame:
    """Per calendar period: last price, compounded return, share of positive returns."""
    return df.groupBy(*by, F.date_trunc(unit, ts).alias("period")).agg(
        F.max_by(price, ts).alias("last_close"),
        (F.exp(F.sum(compound(ret))) - 1).alias("compounded"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def cumulative_share(totals: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Running share of the total from the largest down; ``in_first`` marks the keys that reach ``share``.

    ``totals`` holds one row per key (already aggregated), so the global order is over keys only.
    """
    order = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    df = totals.withColumns({"_run": F.sum(value).over(order), "_all": F.sum(value).over(everything)})
    return df.withColumns({
        "cumulative_share": F.col("_run") / F.col("_all"),
        "in_first": (F.col("_run") - F.col(value)) / F.col("_all") < share,
    }).drop("_run", "_all")


def t_tests(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Equal-variance and paired t statistics of two columns, and the share of rows where a > b."""
    n = F.count(F.lit(1))
    pooled = (F.var_samp(a) + F.var_samp(b)) / 2
    gap = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(
        n.alias("n"),
        ratio(F.avg(a) - F.avg(b), F.sqrt(pooled * 2 / n)).alias("t_equal_var"),
        ratio(F.avg(gap), F.stddev_samp(gap) / F.sqrt(n)).alias("t_paired"),
        F.avg(F.when(F.col(a) > F.col(b), 1.0).otherwise(0.0)).alias("win_rate"),
    )


def with_islands(df: DataFrame, label: str, axis: Axis = BARS) -> DataFrame:
    """Number the runs of equal labels within each series."""
    df = windowed(
        df, lambda d, a: d.withColumn("_chg", (~F.col(label).eqNullSafe(prev(label, a)) | prev(a.order[0], a).isNull()).cast("int")), axis, lookback=1
    )
    return running(df, {"island": ("sum", "_chg")}, axis).drop("_chg")


def islands(df: DataFrame, label: str, axis: Axis = BARS) -> DataFrame:
    """One row per run of equal labels: length and span."""
    ts = axis.order[0]
    return with_islands(df, label, axis).groupBy(*axis.keys, "island", label).agg(
        F.count(F.lit(1)).alias("bars"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")
    )


def drawdown_episodes(df: DataFrame, value: str, axis: Axis = BARS) -> DataFrame:
    """Each spell below the running peak: start, length and depth."""
    df = running(df, {"_peak": ("max", value)}, axis)
    df = df.withColumn("_dd", F.col(value) / F.col("_peak") - 1).withColumn("_under", F.col("_dd") < 0)
    df = with_islands(df, "_under", axis)
    return df.where("_under").groupBy(*axis.keys, "island").agg(
        F.min(axis.order[0]).alias("start_ts"), F.count(F.lit(1)).alias("bars"), F.min("_dd").alias("depth")
    )
