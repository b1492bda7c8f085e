"""Row-wise maths of a panel in long form: aggregates per date, joined back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import clip, ratio
from tidemark.operators.quantiles import with_quantiles
from tidemark.operators.series import Axis, roll_mean, roll_std


def per_group(df: DataFrame, by: Sequence[str], outputs: Mapping[str, Column], hot: bool | None = False) -> DataFrame:
    """Attach group aggregates to every row.

    A group of a panel is a date, with at most one row per name, or a series whose size was checked;
    then one exchange on the group serves all outputs and the plan stays linear. With ``hot=True``
    (a group too large for a task) the aggregate is combined before its shuffle and joined back.
    """
    if hot:
        return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in outputs.items()]), list(by))
    w = Window.partitionBy(*by)
    return df.withColumns({n: c.over(w) for n, c in outputs.items()})


def pct_rank(df: DataFrame, column: str, by: Sequence[str], out: str, hot: bool | None = False) -> DataFrame:
    """Percentile rank with ties averaged: (rows below + (ties + 1) / 2) / non-null rows.

    With ``hot=True`` values are counted per distinct value first, so the equal values of a group too
    large for a task meet as one row.
    """
    group = list(by)
    if not hot:
        first = F.rank().over(Window.partitionBy(*group).orderBy(F.asc_nulls_last(column)))
        ties = F.count(column).over(Window.partitionBy(*group, column))
        total = F.count(column).over(Window.partitionBy(*group))
        return df.withColumn(out, F.when(F.col(column).isNotNull(), (first + (ties - 1) / 2) / total))
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_ties"))
    w = Window.partitionBy(*group).orderBy(column)
    below = F.coalesce(F.sum("_ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_ties").over(Window.partitionBy(*group))
    ranks = counts.select(*group, column, ((below + (F.col("_ties") + 1) / 2) / total).alias(out))
    return df.join(ranks, [*group, column], "left")


def zscore(df: DataFrame, column: str, by: Sequence[str], out: str, limit: float | None = None, population: bool = False) -> DataFrame:
    """Standardise inside each group, optionally clipped to ±limit; zero spread gives null."""
    sd = F.stddev_pop(column) if population else F.stddev_samp(column)
    df = per_group(df, by, {"_m": F.avg(column), "_s": sd})
    z = ratio(F.col(column) - F.col("_m"), F.col("_s"))
    return df.withColumn(out, clip(z, -limit, limit) if limit else z).drop("_m", "_s")


def breadth(df: DataFrame, ret: str, intensity: str, ts: str = "ts") -> DataFrame:
    """Per date: mean and absolute return, share of risers, intensity level, and short means."""
    daily = df.groupBy(ts).agg(
        F.avg(ret).alias("mean_ret"),
        F.avg(F.abs(ret)).alias("abs_ret"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("breadth"),
        F.avg(intensity).alias("i_mean"),
        F.stddev_samp(intensity).alias("i_std"),
    )
    a = date_axis(ts)
    return daily.withColumns({
        "i_mom5": roll_mean("i_mean", a, 5, 3),
        "ret_mom5": roll_mean("mean_ret", a, 5, 3),
        "ret_mom10": roll_mean("mean_ret", a, 10, 5),
        "vol20": roll_std("mean_ret", a, 20, 10),
    })


def date_axis(ts: str = "ts", keys: Sequence[str] = ()) -> Axis:
    """Axis of a date-level table: one row per date (and key), so at most some ten thousand rows."""
    return Axis(tuple(keys), (ts,), hot=False)


def quantile_bins(df: DataFrame, column: str, n: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Right-closed quantile bins, repeated edges dropped; the lowest edge belongs to bin 0."""
    steps = [i / n for i in range(n + 1)]
    joined = with_quantiles(df, column, steps, by, "_e").withColumn("_e", F.array_distinct("_e"))
    below = F.size(F.filter("_e", lambda e: e < F.col(column)))
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_e")


def digitize(value: Column | str, edges: Sequence[float | Column]) -> Column:
    """Index of the bin (edges ascending, bin i holds edge[i-1] <= x < edge[i]); null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(value < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))
