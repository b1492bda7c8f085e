"""Helpers shared by the corpus operators: tables, lineage cuts, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: characters that end a word of the "blank-separated" kind
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: rows that one window task may hold
ROWS_PER_BUCKET = 500_000
#: bytes of text that one step inside a task turns into arrays at a time
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame, light: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends here, lost executors do not matter.

    ``light`` tables (a few numbers per row) are written by an eighth of the shuffle's tasks, as they would be mostly file headers.
    ``codec``: another compression than the session's, for tables of whole texts.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    if light:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column | str) -> Column:
    """Blank-separated words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def doc_text(*parts: Column) -> Column:
    """A text key of columns that may be null."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the right keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def text_key(text: Column | str = "text") -> Column:
    """A 64-bit hash that stands for a text beside its id."""
    return F.xxhash64(text, F.length(text))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in ``bad`` (doc_id, __text); same columns, null ids equal null ids."""
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("__text").alias("__bad_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (text_key(docs["text"]) == F.col("__bad_text")), "left_anti")


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two of hash buckets so that even one group with all rows has bounded buckets."""
    n = 1
    while rows > n * per_bucket and n < 1 << 20:
        n *= 2
    return n


def hashed_prefix_sums(df: DataFrame, by: list[str], key: str, ties: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before, in the order (key, ties).

    ``key`` is a column of hex digits of a hash, hence uniform: its leading digits cut every group into key ranges of at most
    about ``ROWS_PER_BUCKET`` rows. Range totals are summed before the shuffle, their prefix sums are added to
    a running sum inside each range. No task holds a group.
    """
    n = buckets_for(rows)
    bucket = F.shiftright(F.conv(F.substring(key, 1, 5), 16, 10).cast("int"), 20 - (n.bit_length() - 1))
    df = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*by, "__bucket").orderBy(key, *ties)
    here = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    if n == 1:
        return df.withColumn(out, here).drop("__bucket")
    totals = df.groupBy(*by, "__bucket").agg(F.sum(value).alias("__total"))
    ranges = Window.partitionBy(*by).orderBy("__bucket")
    offsets = totals.withColumn("__offset", F.sum("__total").over(ranges) - F.col("__total")).drop("__total")
    df = null_safe(df.withColumn("__here", here), offsets, [*by, "__bucket"])
    return df.withColumn(out, F.col("__here") + F.col("__offset")).drop("__bucket", "__here", "__offset")


def ranged_prefix_sums(df: DataFrame, order: list[Column], values: dict[str, str], parts: int) -> DataFrame:
    """Add, for each ``out: value``, the sum of ``value`` over all rows that come before in ``order`` (which must be total).

    Rows are range-partitioned and written, so that every range has a number; range totals (one row per range) give
    the offsets, a window inside each range the rest.
    """
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"__t_{o}") for o, v in values.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per range
    offsets = totals.select("__range", *[(F.sum(f"__t_{o}").over(before) - F.col(f"__t_{o}")).alias(f"__o_{o}") for o in values])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = ranged.join(offsets, "__range")
    for o, v in values.items():
        df = df.withColumn(o, F.sum(v).over(inside) - F.col(v) + F.col(f"__o_{o}"))
    return df.drop("__range", *[f"__o_{o}" for o in values])


class Slice(NamedTuple):
    """Some rows of an Arrow batch."""

    rows: pa.RecordBatch
    texts: pa.Array


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into runs of rows with about ``limit`` bytes of text, so that work arrays stay small."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield Slice(batch.slice(start, i - start), texts.slice(start, i - start))
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield Slice(batch.slice(start), texts.slice(start))


def connected(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex: (id, component). ``edges`` has long columns a and b.

    Large-star and small-star steps in turn, each written to the shared folder, until every edge leads from a vertex to the
    smallest of its component; minima are aggregated before the shuffle, so a vertex with many links is one row per task.
    Vertices without a link are not returned.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), light=True)
    while True:
        # done: every vertex has one edge down and none of those it leads to has one
        ends = current.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("down")))).alias("e"))
        ends = ends.groupBy("e.v").agg(F.sum("e.down").alias("down"), F.count(F.lit(1)).alias("all"))
        if not ends.where("down > 1 or (down > 0 and `all` > down)").limit(1).count():
            break
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a vertex point to the vertex's minimum
        large = cut(around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), light=True)
        # small star: smaller neighbours and the vertex itself point to the minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        current = cut(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), light=True)
    stars = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return cut(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), light=True)


#: most bits of a filter of ids that every task may hold (2 MB)
FILTER_BITS = 1 << 24


def bit_filter(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray | None:
    """A bit per hash cell that holds a value of a long column, as 64-bit words; about 16 cells per row.

    None where ``FILTER_BITS`` cells are too few for the rows: then a join has to do. Fixed ``bits`` never give None.
    """
    if bits is None:
        rows = df.count()
        if rows > FILTER_BITS // 4:
            return None
        bits = 1 << 10
        while bits < 16 * rows and bits < FILTER_BITS:
            bits *= 2
    slot = F.col(column).bitwiseXOR(F.shiftrightunsigned(column, 32)).bitwiseAND(bits - 1)
    cells = df.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # bits / 64 rows at most
        out[r["cell"]] = r["bits"]
    return out.view(np.uint64)


def in_filter(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    values = values.astype(np.int64, copy=False).view(np.uint64)
    slot = (values ^ (values >> np.uint64(32))) & np.uint64(64 * len(words) - 1)
    return ((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
