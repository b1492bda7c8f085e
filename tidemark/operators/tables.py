"""Row-set operators: schema conforming, fills, de-duplication, filters, splits, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cleaning import clip, to_double, to_utc
from tidemark.operators.quantiles import with_quantiles
from tidemark.operators.series import BARS, Axis, checked, has_hot_key, join_same, positions, rows_per_task, running, windowed

# --- schema ----------------------------------------------------------------------------------


def _plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def conform(df: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Rename columns to canonical names; aliases match case-insensitively, ignoring punctuation.

    The first alias that is present wins. A required name without a match is an error, as schema
    problems must surface when the plan is built and not in a task.
    """
    present = {}
    for name in df.columns:
        present.setdefault(_plain(name), name)
    found = {}
    for target, aliases in wanted.items():
        source = next((present[_plain(a)] for a in (target, *aliases) if _plain(a) in present), None)
        if source is not None:
            found[target] = source
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{s}`").alias(t) for t, s in found.items()])


def coerce(df: DataFrame, doubles: Sequence[str] = (), times: Sequence[str] = ()) -> DataFrame:
    """Typed columns; values that do not parse become null."""
    return df.withColumns({**{c: to_double(c) for c in doubles}, **{c: to_utc(c) for c in times}})


def clean_bars(df: DataFrame, required=("ts", "symbol", "close")) -> DataFrame:
    """Coerce a raw bar frame and drop rows without key, time or price."""
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    return coerce(df, numbers, ("ts",)).dropna(subset=list(required))


# --- fills -----------------------------------------------------------------------------------


def forward_fill(df: DataFrame, columns: Sequence[str], axis: Axis = BARS) -> DataFrame:
    return running(df, {c: ("last", c) for c in columns}, axis)


def backward_fill(df: DataFrame, columns: Sequence[str], axis: Axis = BARS) -> DataFrame:
    """Look-ahead fill; callers opt in."""
    return running(df, {c: ("last", c) for c in columns}, axis.reversed())


def group_mean_fill(df: DataFrame, column: str, by: Sequence[str], default: float = 0.0) -> DataFrame:
    """Missing values take the mean of their group, then ``default``; a group too large for a task is averaged before the shuffle."""
    if has_hot_key(df, Axis(tuple(by))):
        means = df.groupBy(*by).agg(F.avg(column).alias("_mean"))
        filled = join_same(df, means, list(by), "left")
        return filled.withColumn(column, F.coalesce(F.col(column), F.col("_mean"), F.lit(default))).drop("_mean")
    mean = F.avg(column).over(Window.partitionBy(*by))
    return df.withColumn(column, F.coalesce(F.col(column), mean, F.lit(default)))


def interpolate(df: DataFrame, column: str, axis: Axis = BARS) -> DataFrame:
    """Linear interpolation by row position; ends take the nearest known value (looks ahead)."""
    df = positions(df, axis, "_pos")
    known = F.when(F.col(column).isNotNull(), F.col("_pos"))
    df = running(df, {"_v0": ("last", column), "_p0": ("last", known)}, axis)
    df = running(df, {"_v1": ("last", column), "_p1": ("last", known)}, axis.reversed())
    share = (F.col("_pos") - F.col("_p0")) / F.nullif(F.col("_p1") - F.col("_p0"), F.lit(0))
    blend = F.col("_v0") + share * (F.col("_v1") - F.col("_v0"))
    return df.withColumn(column, F.coalesce(column, blend, "_v0", "_v1")).drop("_pos", "_v0", "_p0", "_v1", "_p1")


# --- duplicates and group picks --------------------------------------------------------------


def keep_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str | Column]) -> DataFrame:
    """One row per key, the one with the largest ``seq``; a plain aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(s) if isinstance(s, str) else s for s in seq])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_rows(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """The newest ``n`` rows per key; the planner limits each task's groups before the shuffle."""
    back = F.row_number().over(axis.reversed().spec())
    return df.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_group_size(df: DataFrame, by: Sequence[str], name: str, hot: bool | None = False) -> DataFrame:
    """Number of rows of the row's group; ``hot=True`` counts before the shuffle and joins back."""
    if hot:
        return df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), list(by))
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))


def min_history(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    enough = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(enough, list(by), "left_semi")


def first_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first ``n`` keys in key order."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def common_range(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows inside the date range that every key covers."""
    spans = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    shared = spans.agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    # one row by construction: the bounds of the shared range
    return df.join(F.broadcast(shared), F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def calendar_complete(df: DataFrame, key: str, ts: str, step: str = "interval 1 day") -> DataFrame:
    """Every key on every date of its own span; missing rows have null values.

    Each key expands its own date sequence, so no key-by-date product is formed.
    """
    if isinstance(df.schema[ts].dataType, T.DateType) and step == "interval 1 day":
        return _days_complete(df, key, ts)
    spans = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = spans.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(ts))
    return grid.join(df, [key, ts], "left")


def _days_complete(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``calendar_complete`` by days without a join: every row brings the missing days up to the next row of its key.

    Of a null key every date of the span gives one row without values, as from a join on the key.
    """
    axis = checked(df, Axis((key,), (ts,)))
    others = [c for c in df.columns if c not in (key, ts)]
    rows = df.where(F.col(ts).isNotNull())
    if not axis.hot:
        spans = rows.groupBy(key).agg((F.date_diff(F.max(ts), F.min(ts)) + 1).alias("_days"))
        spark, days = df.sparkSession, spans.agg(F.sum("_days")).first()[0] or 0
        rows = rows.repartition(max(-(-days // rows_per_task(spark)), spark.sparkContext.defaultParallelism), key)
    gap = windowed(rows, lambda d, a: d.withColumn("_next", F.lead(ts).over(a.spec())), axis, lookahead=1)
    gap = gap.withColumn("_days", F.date_diff("_next", ts)).where(~(F.col(key).isNull() & F.coalesce(F.col("_days") == 0, F.lit(False))))
    days = gap.select(key, ts, *others, F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("_days", F.lit(1)), F.lit(1)) - 1)).alias("_day"))
    own = (F.col("_day") == 0) & F.col(key).isNotNull()
    return days.select(key, F.date_add(ts, F.col("_day")).alias(ts), *[F.when(own, F.col(c)).alias(c) for c in others])


def panel_complete(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Every key on every date of the panel's span (long form of a reindexed matrix)."""
    shared = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    keys = df.select(key).distinct()
    spans = keys.join(F.broadcast(shared))  # one row: the panel's first and last date
    grid = spans.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(ts))
    return grid.join(df, [key, ts], "left")


# --- filters and scaling ---------------------------------------------------------------------


def every(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given; null counts as false."""
    terms = [F.coalesce(p, F.lit(False)) for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def minutes_of_day(ts: str | Column, zone: str | None = None) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    local = F.from_utc_timestamp(ts, zone) if zone else ts
    return F.hour(local) * 60 + F.minute(local)


def in_session(ts: str, start: int, end: int, guard: int = 0, zone: str | None = None) -> Column:
    """Inside the session (minutes of the day), at least ``guard`` minutes from both ends."""
    return minutes_of_day(ts, zone).between(start + guard, end - guard)


def winsorise(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Clip to the exact quantiles of the group."""
    joined = with_quantiles(df, column, [low, high], by)
    return joined.withColumn(column, clip(column, F.col("_q")[0], F.col("_q")[1])).drop("_q")


def time_split(df: DataFrame, ts: str, share: float) -> DataFrame:
    """Add ``is_train``: the first floor(share * dates) distinct dates are training dates."""
    dates = df.select(ts).distinct()
    # after the distinct only one row per date is left, so one ordered pass over it is small
    ranked = dates.select(ts, F.row_number().over(Window.orderBy(ts)).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    flags = ranked.select(ts, (F.col("_i") <= F.floor(F.col("_n") * F.lit(share))).alias("is_train"))
    return df.join(flags, ts)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """Wide series to rows; the null tail of a short series is dropped."""
    entries = F.array(*[F.struct(F.lit(i).alias(step), F.col(c).cast("double").alias(value)) for i, c in enumerate(values)])
    return df.select(*ids, F.explode(entries).alias("_e")).select(*ids, f"_e.{step}", f"_e.{value}").where(F.col(value).isNotNull())


def resolve_symbols(wanted: DataFrame, catalog: DataFrame, symbol: str = "symbol") -> DataFrame:
    """First catalog match per wanted symbol among its spellings; ``resolved`` is null when none is listed."""
    s = F.col(symbol)
    # fixed values: exchange suffix and separator spellings, in order of preference
    spellings = F.array(s, F.concat(s, F.lit(".SA")), F.replace(s, F.lit("/"), F.lit("-")), F.replace(s, F.lit("-"), F.lit("/")))
    tried = wanted.select(symbol, F.posexplode(F.array_distinct(spellings)).alias("_rank", "resolved"))
    listed = catalog.select(F.col(symbol).alias("resolved")).distinct()
    hits = tried.join(listed, "resolved").groupBy(symbol).agg(F.min_by("resolved", "_rank").alias("resolved"))
    return wanted.join(hits, symbol, "left")
