"""Readers for landed files. All return lazy DataFrames with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import clean_bars, conform, keep_last

LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 200

BAR_ALIASES = {
    "asset_group": ("group",),
    "symbol": ("ticker",),
    "ts": ("timestamp", "date", "datetime"),
    "open": (),
    "high": (),
    "low": (),
    "close": (),
    "volume": (),
}
BAR_REQUIRED = ("asset_group", "symbol", "ts", "open", "high", "low", "close", "volume")

ARTICLES = T.StructType([
    T.StructField(n, T.StringType()) for n in ("Date", "Stock_symbol", "Article", "Article_title", "Url")
])

# fixed values: record layout of the exchange history file (name, width), prices are in hundredths
EXCHANGE_LAYOUT = (
    ("record_type", 2), ("trade_date", 8), ("bdi_code", 2), ("ticker", 12), ("market_type", 3), ("company", 12),
    ("specification", 10), ("term_days", 3), ("currency", 4), ("open", 13), ("high", 13), ("low", 13), ("average", 13),
    ("close", 13), ("best_bid", 13), ("best_ask", 13), ("trades", 5), ("quantity", 18), ("turnover", 18),
    ("strike", 13), ("correction", 1), ("expiry", 8), ("quote_factor", 7), ("strike_points", 13), ("isin", 12),
    ("distribution", 3),
)
EXCHANGE_PRICES = ("open", "high", "low", "average", "close", "best_bid", "best_ask", "turnover", "strike")
QUOTE_RECORD = "01"
KEPT_BDI = ("02", "12")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or headed CSV by extension."""
    lower = path.lower()
    if lower.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if lower.endswith(".csv"):
        return spark.read.csv(path, header=True)
    raise ValueError(f"unsupported extension: {path}")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """OHLCV bars: canonical names, required columns, coerced types, rows without key dropped."""
    return clean_bars(conform(read_table(spark, path), BAR_ALIASES, BAR_REQUIRED))


def read_ticker_csvs(spark: SparkSession, folder: str, tickers: Sequence[str] = (), limit: int | None = None, folders: bool = False) -> DataFrame:
    """One CSV per ticker; the ticker is the upper-cased file name, or with ``folders`` the value of its ``file=`` folder.

    A ticker list becomes a list of paths, so other files are never opened. ``limit`` keeps the first
    files in name order.
    """
    one = "file={}" if folders else "{}.csv"
    paths = [f"{folder}/{one.format(t)}" for t in tickers] or f"{folder}/{one.format('*')}"
    df = spark.read.option("header", True).csv(paths)
    df = df.withColumn("symbol", ticker_of(F.col("_metadata.file_path")))
    if limit is not None:
        df = df.join(df.select("symbol").distinct().orderBy("symbol").limit(limit), "symbol", "left_semi")
    return df


def ticker_of(file_name: Column) -> Column:
    """Upper-cased ticker of a path: ``.../aaa.csv`` or ``.../file=aaa/part-….csv``."""
    folder = F.regexp_extract(file_name, r"/file=([^/]+)/[^/]+$", 1)
    name = F.regexp_extract(file_name, r"([^/]+?)\.[A-Za-z]+$", 1)
    return F.upper(F.url_decode(F.when(F.length(folder) > 0, folder).otherwise(name)))


def read_articles(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """JSON-lines articles; lines that do not parse are skipped."""
    return spark.read.schema(ARTICLES).option("pathGlobFilter", pattern).json(folder, mode="DROPMALFORMED")


def read_articles_with_rejects(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Parsed articles and, next to them, the lines that failed with the file they are from: one parse, by the corrupt-record column."""
    schema = T.StructType([*ARTICLES.fields, T.StructField("_line", T.StringType())])
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    rows = lines.select(parsed.alias("_a"), F.col("_metadata.file_path").alias("file"))
    return rows.where("_a._line IS NULL").select("_a.*").drop("_line"), rows.where("_a._line IS NOT NULL").select(F.col("_a._line").alias("line"), "file")


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated latin-1 filings, all text, header names trimmed and upper-cased."""
    df = spark.read.csv(path, header=True, sep=";", encoding="ISO-8859-1", mode="DROPMALFORMED")
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c.strip().upper()) for c in df.columns])


def parse_exchange_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fixed-width exchange records → typed rows: quote records of the kept lots only."""
    fields, at = {}, 1
    for name, width in EXCHANGE_LAYOUT:
        fields[name] = F.substring(F.col(column), at, width)
        at += width
    rows = lines.where((fields["record_type"] == QUOTE_RECORD) & fields["bdi_code"].isin(*KEPT_BDI))
    out = {}
    for name, raw in fields.items():
        if name in EXCHANGE_PRICES:
            out[name] = (raw.try_cast("bigint").cast("decimal(20,0)") / 100).cast("decimal(15,2)")
        elif name in ("trades", "quantity"):
            out[name] = raw.try_cast("bigint")
        elif name == "trade_date":
            out[name] = F.try_to_date(raw, "yyyyMMdd")
        else:
            out[name] = F.trim(raw)
    return rows.select(*[c.alias(n) for n, c in out.items()])


def read_exchange_history(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.option("encoding", "ISO-8859-1").csv(paths, schema="value string", sep="\u0001", quote="", escape="")
    return parse_exchange_lines(lines)


def read_exchange_range(spark: SparkSession, table: str, years: Sequence[int], tickers: Sequence[str] = ()) -> DataFrame:
    """Year-partitioned history: only the wanted year folders are listed and read."""
    df = spark.read.parquet(table).where(F.col("year").isin([int(y) for y in years]))
    return df.where(F.col("ticker").isin(list(tickers))) if tickers else df


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned tree of Parquet files, listed by ``LISTING_TASKS`` tasks per parent folder: Spark's own way is a task per folder, up to 10,000."""
    held = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(held), LISTING_TASKS)))
    try:
        return spark.read.parquet(path)  # lists at once
    finally:
        spark.conf.set(LISTING, held)


def ticker_universe(left: DataFrame, right: DataFrame, column: str = "symbol") -> DataFrame:
    """Tickers present on both sides."""
    return left.select(column).intersect(right.select(column))


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source that has a key; later sources only fill keys that are missing."""
    stacked = None
    for rank, df in enumerate(sources):
        tagged = df.withColumn("_rank", F.lit(-rank))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return keep_last(stacked, keys, ["_rank"]).drop("_rank")
