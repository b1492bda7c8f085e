"""Ordered per-key computation: trailing windows, running aggregates, stateful scans.

Every series operator in the library goes through one of three primitives:

``windowed``  finite row frames (moving averages, lags, look-ahead windows)
``running``   associative running aggregates (sum, max, last known value)
``scan``      recurrences with state (exponential means, hysteresis, cooldowns)

All three run with one exchange on the key while every key fits a task. The size of the largest key
is checked first; when one key is larger than ``spark.tidemark.rowsPerTask`` its rows are cut into
numbered blocks that spread over the cluster:

* ``windowed`` copies the last ``lookback`` rows of a block into the next one, so frames stay exact;
* ``running`` adds the prefix of the block totals to the aggregate inside the block;
* ``scan`` runs all blocks at once from guessed entry states and repeats until every block's entry
  state equals the exit state of the block before it, so the result is the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import ensure_checkpoint_dir

ROWS_PER_TASK = "spark.tidemark.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class Axis:
    """What identifies a series and what orders its rows."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    descending: bool = False
    hot: bool | None = None  # answer of the size check; None means not asked yet

    def spec(self) -> WindowSpec:
        cols = [F.col(c).desc() if self.descending else F.col(c) for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*cols)

    def trailing(self, n: int) -> WindowSpec:
        return self.spec().rowsBetween(-(n - 1), 0)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.spec().rowsBetween(start, end)

    def so_far(self) -> WindowSpec:
        return self.spec().rowsBetween(Window.unboundedPreceding, 0)

    def within(self, *extra: str) -> Axis:
        return replace(self, keys=self.keys + extra)

    def reversed(self) -> Axis:
        return replace(self, descending=not self.descending)


BARS = Axis()


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


#: (application, files read) → {keys: rows of the most frequent key}; the oldest source is forgotten first
_LARGEST: dict[tuple, dict[tuple[str, ...], int]] = {}
_SOURCES = 256
#: a source whose largest key is this many times below the limit is not asked again for the frames derived from it
_MARGIN = 50


def _answers(df: DataFrame) -> dict[tuple[str, ...], int]:
    files = df.inputFiles()
    source = tuple(sorted(files)) if files else df.semanticHash()
    memo = (df.sparkSession.sparkContext.applicationId, source)
    if memo not in _LARGEST and len(_LARGEST) >= _SOURCES:
        _LARGEST.pop(next(iter(_LARGEST)))
    return _LARGEST.setdefault(memo, {})


def largest_key(df: DataFrame, keys: Iterable[str]) -> int:
    """Rows of the most frequent key: one column-pruned count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def has_hot_key(df: DataFrame, axis: Axis) -> bool:
    """Whether a key has more rows than a task should hold; the answer changes the plan, never the rows.

    A source is counted once: windows add no rows and further keys only split groups, so frames that read the same files are
    counted anew only if the source's largest key comes within ``_MARGIN`` of the limit.
    """
    if axis.hot is not None:
        return axis.hot
    limit, known = rows_per_task(df.sparkSession), _answers(df)
    if any(set(keys) <= set(axis.keys) and n * _MARGIN <= limit for keys, n in known.items()):
        return False
    n = largest_key(df, axis.keys)
    known[axis.keys] = max(n, known.get(axis.keys, 0))
    return n > limit


def checked(df: DataFrame, axis: Axis = BARS) -> Axis:
    """The axis with the size check answered for ``df``; operators that keep its rows reuse it."""
    return replace(axis, hot=has_hot_key(df, axis))


def spread(df: DataFrame, axis: Axis, fan: int) -> DataFrame:
    """The rows by key, in as many partitions as keep ``fan`` copies of them within a task's rows each.

    A fan-out behind an exchange of small rows multiplies what a task sorts, and the size of the exchange does not tell. Series larger than
    a task take the numbered blocks instead.
    """
    if has_hot_key(df, axis):
        return df
    spark = df.sparkSession
    parts = -(-df.select(*axis.keys).count() * fan // rows_per_task(spark))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), *axis.keys)


def _time_bucket(df: DataFrame, column: str) -> Column:
    """A coarse column with the order of ``column``; null for null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.trunc(column, "month")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", column)
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(column) / F.lit(1024))
    return F.substring(F.col(column).cast("string"), 1, 4) if isinstance(kind, T.StringType) else F.col(column)


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the columns of the left side stay."""
    right = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in on])
    return left.join(right, match, how).drop(*[f"_same_{c}" for c in on])


def number_rows(df: DataFrame, axis: Axis = BARS, out: str = "rn") -> DataFrame:
    """0-based position of each row in its series, without a task that holds a whole series.

    Rows are counted per (key, time bucket); the running total of those small counts is each
    bucket's first position, and ``row_number`` only runs inside a bucket. A null key is a series and
    null times come first (last in descending order), as in the plain window. Where a bucket is too
    crowded for a task, every distinct time is a bucket of its own.
    """
    on = [*axis.keys, "_bucket"]
    limit = rows_per_task(df.sparkSession)
    tagged = df.withColumn("_bucket", _time_bucket(df, axis.order[0]))
    if largest_key(tagged, on) > limit:
        tagged = df.withColumn("_bucket", F.col(axis.order[0]))
    counts = tagged.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    direction = F.col("_bucket").desc() if axis.descending else F.col("_bucket")
    before = (
        Window.partitionBy(*axis.keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(*on, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(axis.within("_bucket").spec())
    return (
        join_same(tagged, starts, on)
        .withColumn(out, (F.col("_first") + inside - 1).cast("long"))
        .drop("_bucket", "_first")
    )


def positions(df: DataFrame, axis: Axis = BARS, out: str = "rn") -> DataFrame:
    """0-based row position: a plain window, or ``number_rows`` when a key is too large for it."""
    if has_hot_key(df, axis):
        return number_rows(df, axis, out)
    return df.withColumn(out, (F.row_number().over(axis.spec()) - 1).cast("long"))


def windowed(
    df: DataFrame,
    add: Callable[[DataFrame, Axis], DataFrame],
    axis: Axis = BARS,
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Run ``add``, which only adds columns over frames of ``axis``, exactly and without a hot task.

    ``lookback``/``lookahead`` bound the rows any added column can depend on (sums of nested frames).
    """
    if not has_hot_key(df, axis):
        return add(df, axis)
    size = max(rows_per_task(df.sparkSession) // 2, 2 * (lookback + lookahead), 1)
    numbered = number_rows(df, axis, "_rn").withColumn("_own", F.floor(F.col("_rn") / size))
    offset = F.col("_rn") % size
    homes = F.array_compact(
        F.array(
            F.col("_own"),
            F.when(offset >= size - lookback, F.col("_own") + 1),
            F.when((offset < lookahead) & (F.col("_own") > 0), F.col("_own") - 1),
        )
    )
    spread = numbered.withColumn("_block", F.explode(homes)).drop("_rn")
    return add(spread, axis.within("_block")).where("_block = _own").drop("_own", "_block")


_INSIDE = {
    "sum": lambda c, w: F.sum(c).over(w),
    "count": lambda c, w: F.count(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
    "first": lambda c, w: F.first(c, ignorenulls=True).over(w),
}
_JOIN = {
    "sum": lambda before, here: F.when(
        before.isNotNull() | here.isNotNull(),
        F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    ),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
    "last": lambda before, here: F.coalesce(here, before),
    "first": lambda before, here: F.coalesce(before, here),
}


def running(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, Column | str]],
    axis: Axis = BARS,
) -> DataFrame:
    """Add running aggregates ``{name: (kind, input)}`` over each series up to the current row."""
    inputs = {name: (F.col(c) if isinstance(c, str) else c) for name, (_, c) in outputs.items()}
    kinds = {name: kind for name, (kind, _) in outputs.items()}
    if not has_hot_key(df, axis):
        w = axis.so_far()
        return df.withColumns({n: _INSIDE[kinds[n]](inputs[n], w) for n in outputs})

    size = max(rows_per_task(df.sparkSession) // 2, 1)
    blocked = number_rows(df, axis, "_rn").withColumn("_block", F.floor(F.col("_rn") / size))
    blocked = blocked.withColumns({f"_in_{n}": c for n, c in inputs.items()})
    on = [*axis.keys, "_block"]
    total = {
        "sum": F.sum,
        "count": F.count,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_rn"))),
        "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_rn"))),
    }
    totals = blocked.groupBy(*on).agg(*[total[kinds[n]](f"_in_{n}").alias(f"_t_{n}") for n in outputs])
    earlier = Window.partitionBy(*axis.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    merge = {**_INSIDE, "count": lambda c, w: F.sum(c).over(w)}
    prefix = totals.select(*on, *[merge[kinds[n]](F.col(f"_t_{n}"), earlier).alias(f"_p_{n}") for n in outputs])
    inside = axis.within("_block").so_far()
    out = join_same(blocked, prefix, on, "left").withColumns(
        {n: _JOIN[kinds[n]](F.col(f"_p_{n}"), _INSIDE[kinds[n]](F.col(f"_in_{n}"), inside)) for n in outputs}
    )
    return out.drop("_rn", "_block", *[f"_in_{n}" for n in outputs], *[f"_p_{n}" for n in outputs])


def in_order(rows: pa.Table, order: Sequence[str], descending: bool) -> pa.Table:
    """Null times first, as in windows (last in descending order)."""
    keys = [(c, "descending" if descending else "ascending") for c in order]
    at = pc.sort_indices(rows, sort_keys=keys, null_placement="at_end" if descending else "at_start")
    return rows.take(at)


def arrow_column(values, kind: T.DataType) -> pa.Array:
    """Values of a step as an Arrow column; NaN is null, as on the way back from pandas."""
    return pa.array(values, type=to_arrow_type(kind), from_pandas=True)


def scan(
    df: DataFrame,
    step: Callable,
    schema: str,
    axis: Axis = BARS,
    max_rounds: int = 10_000,
    needs: Sequence[str] | None = None,
) -> DataFrame:
    """Ordered recurrence per key. ``step(pdf, state) -> (columns, state)`` sees rows in order.

    ``step`` gets a pandas frame sorted by the axis and the state after the rows before it (``None``
    at the start of a series); it returns a dict of new columns, as listed in the DDL ``schema``,
    and the state as a list of floats. Arrow carries the batches; Spark owns the partitioning. ``needs`` names
    the columns that ``step`` reads; the others stay Arrow columns and are not made into Python objects.
    """
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    order, descending = list(axis.order), axis.descending
    names = [f.name for f in added.fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    out_schema = T.StructType(kept + list(added.fields))
    columns = [f.name for f in out_schema.fields]

    def replay(pdf, state):
        # null times first, as in windows (last in descending order)
        pdf = pdf.sort_values(order, ascending=not descending, kind="mergesort", na_position="last" if descending else "first").reset_index(drop=True)
        produced, state = step(pdf, state)
        return pdf.assign(**produced)[columns], state

    if not has_hot_key(df, axis):
        read = list(needs) if needs is not None else df.columns

        def whole(rows: pa.Table) -> pa.Table:
            rows = in_order(rows, order, descending)
            produced, _ = step(rows.select(read).to_pandas(), None)
            made = dict(zip(rows.column_names, rows.columns, strict=True))
            made |= {f.name: arrow_column(produced[f.name], f.dataType) for f in added.fields}
            return pa.table({c: made[c] for c in columns})

        return df.groupBy(*axis.keys).applyInArrow(whole, out_schema)

    ensure_checkpoint_dir(df.sparkSession)
    size = max(rows_per_task(df.sparkSession) // 2, 1)
    on = [*axis.keys, "_block"]
    blocked = number_rows(df, axis, "_rn").withColumn("_block", F.floor(F.col("_rn") / size)).drop("_rn")
    blocked = blocked.checkpoint()
    key_fields = [f for f in blocked.schema.fields if f.name in on]
    state_type = T.ArrayType(T.DoubleType())
    exit_schema = T.StructType(key_fields + [T.StructField("_exit", state_type)])

    def entry_of(pdf):
        value = pdf["_entry"].iloc[0]
        return None if value is None else list(value)

    def exits(pdf):
        _, state = replay(pdf.drop(columns="_entry"), entry_of(pdf))
        return pdf[[f.name for f in key_fields]].head(1).assign(_exit=[state])

    before = Window.partitionBy(*axis.keys).orderBy("_block")
    entries = blocked.select(*on).distinct().select("*", F.lit(None).cast(state_type).alias("_entry"), F.lit(None).cast(state_type).alias("_exit"), F.lit(True).alias("_moved"))
    entries = entries.checkpoint()
    for _ in range(max_rounds):
        # only blocks whose entry state moved are replayed; the others keep their exit state
        moved = entries.where("_moved").select(*on, "_entry")
        ends = join_same(blocked, moved, on).groupBy(*on).applyInPandas(exits, exit_schema)
        ended = join_same(entries, ends.withColumnRenamed("_exit", "_new"), on, "left")
        ended = ended.withColumn("_exit", F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("_exit")))
        entries = (
            ended.withColumn("_next", F.lag("_exit").over(before))
            .select(*on, F.col("_next").alias("_entry"), "_exit", (~F.col("_entry").eqNullSafe(F.col("_next"))).alias("_moved"))
            .checkpoint()
        )
        if entries.where("_moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("scan did not settle; raise max_rounds")
    return (
        join_same(blocked, entries.select(*on, "_entry"), on)
        .groupBy(*on)
        .applyInPandas(lambda pdf: replay(pdf.drop(columns=["_entry", "_block"]), entry_of(pdf))[0], out_schema)
    )


def _states(moves: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(state behind each row from ``start``, map of all rows) for maps ``moves[row, state] -> state``.

    Rows are laid out as about √n strips of √n rows: all strips compose their maps at once, then the strips' totals follow one another.
    """
    n, states = moves.shape
    width = int(n**0.5) + 1
    strips = -(-n // width)
    same = np.arange(states, dtype=moves.dtype)
    laid = np.concatenate([moves, np.broadcast_to(same, (strips * width - n, states))]).reshape(strips, width, states)
    so_far = np.empty_like(laid)
    total = np.broadcast_to(same, (strips, states))
    for j in range(width):
        total = np.take_along_axis(laid[:, j], total, axis=1)
        so_far[:, j] = total
    entry, whole = np.empty(strips, dtype=np.int64), same
    for k in range(strips):
        entry[k] = whole[start]
        whole = total[k][whole]
    return so_far[np.arange(strips), :, entry].reshape(-1)[:n], whole


#: rows whose maps lie in memory at a time
_MAPS_AT_ONCE = 65_536


def machines(df: DataFrame, moves: Mapping[str, tuple[Column | Callable, int]], axis: Axis = BARS) -> DataFrame:
    """Add, per ``name: (next states, first state)``, the state of a finite machine behind each row.

    The next states of a row, one for each state before it, are an array column or, where that would be long, a function of the rows (a pandas
    frame) that gives them as a matrix. A row is a map from states to states, so blocks of rows are maps as well, and maps compose: with a hot key all blocks give their map
    in one pass, the few maps of a key are composed in order, and a second pass starts each block in its entry state. No block is replayed.
    """
    names = list(moves)
    tagged = df.withColumns({f"_m_{n}": c.cast("array<int>") for n, (c, _) in moves.items() if isinstance(c, Column)})
    makers = {n: c for n, (c, _) in moves.items() if not isinstance(c, Column)}
    order, descending = list(axis.order), axis.descending
    kept = list(df.schema.fields)
    out_schema = T.StructType(kept + [T.StructField(n, T.IntegerType()) for n in names])
    columns = [f.name for f in out_schema.fields]

    def arranged(pdf):
        return pdf.sort_values(order, ascending=not descending, kind="mergesort", na_position="last" if descending else "first")

    def walk(pdf, name, start):
        """States from ``start``, and the map of all rows."""
        seen, whole = [], None
        for at in range(0, len(pdf), _MAPS_AT_ONCE):
            rows = pdf.iloc[at : at + _MAPS_AT_ONCE]
            table = makers[name](rows) if name in makers else np.vstack(rows[f"_m_{name}"].to_numpy())
            states, total = _states(table.astype(np.int32), start if whole is None else int(whole[start]))
            seen.append(states)
            whole = total if whole is None else total[whole]
        return np.concatenate(seen), whole

    def run(pdf, starts):
        pdf = arranged(pdf)
        return pdf.assign(**{n: walk(pdf, n, s)[0] for n, s in zip(names, starts, strict=True)})[columns]

    first = [s for _, s in moves.values()]
    if not has_hot_key(df, axis):
        return tagged.groupBy(*axis.keys).applyInPandas(lambda pdf: run(pdf, first), out_schema)

    ensure_checkpoint_dir(df.sparkSession)
    size = max(rows_per_task(df.sparkSession) // 2, 1)
    on = [*axis.keys, "_block"]
    blocked = number_rows(tagged, axis, "_rn").withColumn("_block", F.floor(F.col("_rn") / size)).drop("_rn").checkpoint()
    key_fields = [f for f in blocked.schema.fields if f.name in on]
    map_type = [T.StructField(f"_m_{n}", T.ArrayType(T.IntegerType())) for n in names]

    def block_map(pdf):
        pdf = arranged(pdf)
        return pdf[[f.name for f in key_fields]].head(1).assign(**{f"_m_{n}": [walk(pdf, n, 0)[1].tolist()] for n in names})

    maps = blocked.groupBy(*on).applyInPandas(block_map, T.StructType(key_fields + map_type))

    def entries(pdf):
        pdf = pdf.sort_values("_block")
        found = {f"_s_{n}": np.r_[s, _states(np.vstack(pdf[f"_m_{n}"].to_numpy()).astype(np.int32), s)[0][:-1]] for n, s in zip(names, first, strict=True)}
        return pdf[[f.name for f in key_fields]].assign(**found)

    # one row per block of a key
    starts = maps.groupBy(*axis.keys).applyInPandas(entries, T.StructType(key_fields + [T.StructField(f"_s_{n}", T.IntegerType()) for n in names]))
    return join_same(blocked, starts, on).groupBy(*on).applyInPandas(lambda pdf: run(pdf, [int(pdf[f"_s_{n}"].iloc[0]) for n in names]), out_schema)


# ---------------------------------------------------------------------------------------------
# column builders over an axis


def gate(value: Column, source: Column | str, w: WindowSpec, least: int) -> Column:
    """Null until the frame holds ``least`` non-null inputs."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(F.count(source).over(w) >= least, value)


def rolling(kind: Callable[[Column], Column], source: Column | str, axis: Axis, n: int, least: int | None = None) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    w = axis.trailing(n)
    least = n if least is None else least
    return kind(source).over(w) if least <= 1 else gate(kind(source).over(w), source, w, least)


def roll_mean(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, source, axis, n, least)


def roll_sum(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.sum, source, axis, n, least)


def roll_min(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.min, source, axis, n, least)


def roll_max(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.max, source, axis, n, least)


def roll_std(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, source, axis, n, least)


def roll_var(source, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(F.var_samp, source, axis, n, least)


def roll_quantile(source, q: float, axis: Axis, n: int, least: int | None = None) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(q)), source, axis, n, least)


def prev(source, axis: Axis, k: int = 1) -> Column:
    return F.lag(source, k).over(axis.spec())


def following(source, axis: Axis, k: int = 1) -> Column:
    return F.lead(source, k).over(axis.spec())


def pct_change(source: Column | str, axis: Axis, k: int = 1) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return source / F.nullif(prev(source, axis, k), F.lit(0.0)) - 1


def log_return(source: Column | str, axis: Axis, k: int = 1) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    before = prev(source, axis, k)
    return F.when((source > 0) & (before > 0), F.log(source / before))
