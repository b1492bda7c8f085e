"""Exact quantiles by rank selection over counted value ranges: no task sorts or holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import Axis, has_hot_key, join_same, rows_per_task
from tidemark.session import ensure_checkpoint_dir

#: ranges into which a picked range is cut in one round
RANGES = 1024


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on the group; without one ``small`` is a row per quantile edge and is broadcast."""
    return join_same(df, small, list(by)) if by else df.join(F.broadcast(small))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "quantiles", hot: bool | None = None) -> DataFrame:
    """One row per group with a non-null value: ``out``, the linearly interpolated quantiles of ``column``, in the order of ``shares``.

    Groups that fit a task (``rowsPerTask``; ``hot`` is that answer where it is known) are one plain aggregate. Beyond that, each round counts the rows per value range and group
    before the shuffle, and keeps the range that holds each wanted rank together with the smallest and the largest value in it; ranges
    shrink until they hold one value, or few enough rows to be put in order. Null values are ignored, null groups are groups; a NaN has no
    rank and is ignored as well.
    """
    by = list(by)
    value = F.col(column).cast("double")
    rows = df.select(*by, F.when(~F.isnan(value), value + 0.0).alias("_x")).where("_x IS NOT NULL")
    if not has_hot_key(df, Axis(tuple(by), (column,), hot=hot)):
        found = rows.groupBy(*by).agg(F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares])).alias(out), F.count(F.lit(1)).alias("_n"))
        return found.where("_n > 0").drop("_n")
    ensure_checkpoint_dir(df.sparkSession)
    limit = rows_per_task(df.sparkSession)
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_n > 0")
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(*[f(F.lit(float(s)) * (F.col("_n") - 1)).cast("long") for f in (F.floor, F.ceil)]) for s in shares])))
    picked = stats.select(*by, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_here"), F.explode(wanted).alias("_rank")).checkpoint()
    while (picked.where("_lo < _hi").agg(F.max("_here")).first()[0] or 0) > limit:
        spans = picked.where("_lo < _hi").select(*by, "_lo", "_hi", "_before").distinct()
        inside = _attach(rows, spans, by).where("_x BETWEEN _lo AND _hi")
        # halves keep the width finite; the quotient is monotone, so ranges are in value order
        step = F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * RANGES)
        counted = inside.groupBy(*by, "_lo", "_hi", "_before", F.least(step, F.lit(RANGES - 1)).alias("_range"))
        counted = counted.agg(F.count(F.lit(1)).alias("_rows"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        earlier = Window.partitionBy(*by, "_lo", "_hi").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
        counted = counted.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        chosen = join_same(picked.where("_lo < _hi"), counted.drop("_before"), [*by, "_lo", "_hi"]).where("_rank >= _below AND _rank < _below + _rows")
        chosen = chosen.select(*by, "_n", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), F.col("_below").alias("_before"), F.col("_rows").alias("_here"), "_rank")
        picked = picked.where("_lo = _hi").unionByName(chosen).checkpoint()
    spans = picked.where("_lo < _hi").select(*by, "_lo", "_hi", "_before").distinct()
    ordered = Window.partitionBy(*by, "_lo", "_hi").orderBy("_x")  # at most a task's rows
    near = _attach(rows, spans, by).where("_x BETWEEN _lo AND _hi").withColumn("_rank", F.col("_before") + F.row_number().over(ordered) - 1)
    values = join_same(picked.where("_lo < _hi").select(*by, "_n", "_rank"), near.select(*by, "_rank", "_x"), [*by, "_rank"])
    values = values.unionByName(picked.where("_lo = _hi").select(*by, "_n", "_rank", F.col("_lo").alias("_x")))
    at = values.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))  # two per share

    def quantile(share: float):
        place = F.lit(float(share)) * (F.col("_n") - 1)
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return at.select(*by, F.array(*[quantile(s) for s in shares]).alias(out))


def with_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "_q", hot: bool | None = None) -> DataFrame:
    """Attach the group's exact quantiles to every row; null where the group has no value."""
    if by and not has_hot_key(df, Axis(tuple(by), (column,), hot=hot)):
        return df.withColumn(out, F.percentile(column, F.array(*[F.lit(float(s)) for s in shares])).over(Window.partitionBy(*by)))
    edges = exact_quantiles(df, column, shares, by, out, hot)
    return join_same(df, edges, list(by), "left") if by else df.join(F.broadcast(edges), how="left")  # one row without groups
