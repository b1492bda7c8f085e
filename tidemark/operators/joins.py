"""As-of, nearest, range and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import Axis, running


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    direction: str = "backward",
    tolerance_days: float | None = None,
    matched: str = "matched_ts",
    exact: bool = True,
) -> DataFrame:
    """Each left row with the latest right row at or before it (``forward``: the first at or after).

    Both sides are stacked and the last right row seen is carried along the key's time order: one
    exchange on the key, linear work, no pair generation. A right side with several rows at one time
    should be reduced first. ``tolerance_days`` turns matches further away than that into nulls.
    """
    values = [c for c in right.columns if c not in (*keys, ts)]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    forward = direction == "forward"
    # on equal times right rows are met first when exact matches count, last when they do not
    side = 1 if forward == exact else 0
    payload = F.struct(F.col(ts).alias("_at"), *values)
    stacked = left.withColumns({"_side": F.lit(1 - side)}).unionByName(
        right.select(*keys, ts, payload.alias("_right"), F.lit(side).alias("_side")), allowMissingColumns=True
    )
    axis = Axis(tuple(keys), (ts, "_side"), descending=forward)
    carried = running(stacked, {"_hit": ("last", "_right")}, axis).where(F.col("_side") == 1 - side)
    hit = F.col("_hit")
    if tolerance_days is not None:
        gap = F.abs(_seconds(F.col(ts)) - _seconds(F.col("_hit._at")))
        hit = F.when(gap <= tolerance_days * 86400, hit)
    carried = carried.withColumn("_hit", hit)
    return carried.select(*left.columns, F.col("_hit._at").alias(matched), *[F.col(f"_hit.{v}").alias(v) for v in values])


def nearest_join(left: DataFrame, right: DataFrame, keys=("symbol",), ts: str = "ts") -> DataFrame:
    """The right row closest in time; the earlier one wins a tie. Adds ``matched_ts`` and ``gap_seconds``."""
    values = [c for c in right.columns if c not in (*keys, ts)]
    back = asof_join(left, right, keys, ts, matched="_b_ts")
    back = back.withColumnsRenamed({v: f"_b_{v}" for v in values})
    both = asof_join(back, right, keys, ts, direction="forward", matched="_f_ts")
    here = _seconds(F.col(ts))
    gb, gf = here - _seconds(F.col("_b_ts")), _seconds(F.col("_f_ts")) - here
    use_back = F.col("_f_ts").isNull() | (gb <= gf)
    picked = {"matched_ts": F.when(use_back, F.col("_b_ts")).otherwise(F.col("_f_ts"))}
    picked["gap_seconds"] = F.when(use_back, gb).otherwise(gf)
    picked |= {v: F.when(use_back, F.col(f"_b_{v}")).otherwise(F.col(v)) for v in values}
    return both.select(*left.columns, *[c.alias(n) for n, c in picked.items()])


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, reach: float
) -> DataFrame:
    """Pairs with ``left_at - reach <= right_at < left_at`` (numeric times).

    Both sides are cut into buckets of width ``reach`` and joined on (keys, bucket); a left row looks
    into its own bucket and the one before. The bucket is part of the join key, so one busy key
    spreads over as many tasks as it has buckets, and AQE splits a bucket that is still too large.
    """
    lb = F.floor(F.col(left_at) / reach)
    probes = left.withColumn("_b", F.explode(F.array(lb, lb - 1)))
    builds = right.withColumn("_b", F.floor(F.col(right_at) / reach))
    return (
        probes.join(builds, [*keys, "_b"])
        .where((F.col(right_at) < F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - reach))
        .drop("_b")
    )


def membership_flags(df: DataFrame, on: str, sets: dict[str, DataFrame]) -> DataFrame:
    """One boolean per named set: is the row's value in it; plus ``any_flag``."""
    for name, members in sets.items():
        marked = members.select(on).distinct().withColumn(f"_{name}", F.lit(True))
        df = df.join(marked, on, "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    any_flag = None
    for name in sets:
        any_flag = F.col(name) if any_flag is None else (any_flag | F.col(name))
    return df.withColumn("any_flag", any_flag)
