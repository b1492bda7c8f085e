"""Bind the given tables to the library's schemas (bars, trades, quotes, news, embeddings).

Every binding is a lazy plan over a column-pruned Parquet scan. Small dimension joins carry no
broadcast hint: the planner compares their size with its own threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: option quotes that a task builds
QUOTES_PER_TASK = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per supplier: one row per (symbol, ship date), pre-aggregated map-side."""
    price = 100 + (F.col("l_extendedprice") % 1000) / 100
    # one long orders the rows of a bar, so min_by/max_by keep a flat hash-aggregate buffer
    arrival = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("ts"), price.alias("price"), arrival.alias("arrival"), "l_quantity"
    )
    daily = lines.groupBy("l_suppkey", "ts").agg(
        F.min_by("price", "arrival").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "arrival").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    # joined by the key that series are dealt by: a join that deals both sides leaves nothing to deal behind it
    symbol = F.col("l_suppkey").cast("string").alias("symbol")
    daily = daily.select(symbol, "ts", "open", "high", "low", "close", "volume")
    return daily.join(groups(spark, folder).select(symbol, "asset_group"), "symbol").select(
        "asset_group", "symbol", "ts", "open", "high", "low", "close", "volume"
    )


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier → asset group (region name)."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("asset_group"))
    )


def intraday(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly OHLCV bars per event type; volume is the number of events."""
    e = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    return (
        e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumn("day", F.to_date("ts"))
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        F.col("ts").alias("trade_time"),
        (100 + F.col("value") / 10).alias("price"),
        F.col("value").alias("quantity"),
        (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
        ((100 + F.col("value") / 10) * F.col("value")).alias("quote_qty"),
    )


def slow_series(spark: SparkSession, folder: str) -> DataFrame:
    """A slow side series per symbol (funding-rate role): one value per symbol and day."""
    o = table(spark, folder, "orders")
    return (
        o.groupBy((F.col("o_custkey") % 100).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("ts"))
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id"),
        (F.col("doc_id") % 100).cast("string").alias("ticker"),
        F.date_add(F.to_date(F.lit("1995-01-02")), F.col("doc_id").cast("int")).alias("date"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        F.col("lang").alias("language"),
        F.col("source").alias("publisher"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed daily embeddings: ticker, day index, float vector."""
    e = table(spark, folder, "embeddings")
    return e.select(
        "vec_id",
        (F.col("vec_id") % 10).cast("string").alias("ticker"),
        F.floor(F.col("vec_id") / 10).cast("int").alias("day"),
        F.col("embedding").alias("emb"),
        "label",
    )


def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Three class scores per document, dated and keyed like ``news``."""
    positive = 0.5 * F.col("quality")
    negative = 0.5 * F.col("toxic")
    return table(spark, folder, "labels").select(
        "doc_id",
        (F.col("doc_id") % 100).cast("string").alias("ticker"),
        F.date_add(F.to_date(F.lit("1995-01-02")), F.col("doc_id").cast("int")).alias("date"),
        positive.alias("positive"),
        negative.alias("negative"),
        (1 - positive - negative).alias("neutral"),
    )


def option_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes from ``part``: 5 expiries x 5 strikes around the retail price, vol from a formula.

    The fan-out is a fixed literal array per part, so no join is involved. The file is small next to the quotes, so
    its parts are dealt to as many tasks as the quotes need.
    """
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    p = p.repartition(max(-(-p.count() * 25 // QUOTES_PER_TASK), 2 * spark.sparkContext.defaultParallelism), "p_partkey")
    dte = F.explode(F.array(*[F.lit(d) for d in (7, 30, 60, 90, 180)]))
    money = F.explode(F.array(*[F.lit(m) for m in (0.75, 0.9, 1.0, 1.1, 1.25)]))
    q = p.withColumn("dte", dte).withColumn("m", money)
    iv = 0.2 + 0.1 * F.pow(F.col("m") - 1, F.lit(2)) + 0.0002 * F.col("dte") + 0.001 * F.col("p_size")
    return q.select(
        F.col("p_brand").alias("underlying"),
        F.col("p_partkey").alias("contract_id"),
        F.date_add(F.to_date(F.lit("2024-01-02")), (F.col("p_partkey") % 5).cast("int")).alias("quote_date"),
        F.date_add(
            F.to_date(F.lit("2024-01-02")), ((F.col("p_partkey") % 5) + F.col("dte")).cast("int")
        ).alias("expiration"),
        (F.col("p_retailprice") * F.col("m")).alias("strike"),
        F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("option_type"),
        F.col("p_retailprice").alias("underlying_price"),
        iv.alias("true_iv"),
        F.col("p_size").cast("double").alias("volume"),
        (F.col("p_size") * 3).cast("double").alias("open_interest"),
    )
