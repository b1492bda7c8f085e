"""Streaming operators run over the landed event table, file by file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import num, nums, qnum, query, text, with_ctes
from tidemark.sources import bindings as b
from tidemark.streaming import trades as st
from tidemark.streaming.run import arrivals, available_now, land, shared_folder

END = "(end)"


def with_end(trades):
    """One more row long after the last one: the watermark passes every open window. Its own window never closes."""
    last = trades.agg(F.max("trade_time").alias("trade_time"))
    return trades.unionByName(last.select(F.lit(END).alias("symbol"), (F.col("trade_time") + F.expr("INTERVAL 90 DAY")).alias("trade_time")), allowMissingColumns=True)


def landed(spark, d, delay=None):
    """The trades in four files by time and the closing row behind them, as a stream of one file per micro-batch."""
    t = b.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("trade_time"),
        F.col("value").alias("quantity"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker"))
    folder = land(t, "trade_time", 4, delay)
    full = with_end(t)
    full.where(F.col("symbol") == END).coalesce(1).write.mode("append").parquet(folder)
    return arrivals(full, folder)


FLOW = "sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END)", "sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END)"


@query("stream_minute_flow", "Z1 Z5", with_ctes("trades", f"""w AS (SELECT symbol, date_trunc('minute', trade_time) AS ts, {FLOW[0]} AS b, {FLOW[1]} AS s, count(*) AS n FROM trades GROUP BY 1, 2)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, {qnum("b", "buy_volume")}, {qnum("s", "sell_volume")}, {qnum("b - s", "delta")}, n AS trades FROM w"""))
def stream_minute_flow(spark, d):
    out = available_now(st.minute_flow(landed(spark, d)))
    return out.select("symbol", text("ts"), *nums("buy_volume", "sell_volume", "delta"), "trades")


@query("stream_sliding_flow", "Z7", with_ctes("trades", f"""k AS (SELECT *, unnest(range(5)) AS i FROM trades), w AS (SELECT symbol, date_trunc('minute', trade_time) - i * INTERVAL 1 MINUTE AS ts, {FLOW[0]} AS b, {FLOW[1]} AS s FROM k GROUP BY 1, 2)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, {qnum("b", "buy_volume")}, {qnum("s", "sell_volume")} FROM w"""))
def stream_sliding_flow(spark, d):
    out = available_now(st.sliding_flow(landed(spark, d)))
    return out.select("symbol", text("ts"), *nums("buy_volume", "sell_volume"))


@query("stream_session_flow", "Z7", with_ctes("trades", f"""g AS (SELECT *, CASE WHEN trade_time < lag(trade_time) OVER o + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM trades WINDOW o AS (PARTITION BY symbol ORDER BY trade_time)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY trade_time ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT symbol, CAST(min(trade_time) AS VARCHAR) AS ts, {qnum(FLOW[0], "buy_volume")}, {qnum(FLOW[1], "sell_volume")}, count(*) AS trades FROM i GROUP BY symbol, session"""))
def stream_session_flow(spark, d):
    out = available_now(st.session_flow(landed(spark, d)))
    return out.select("symbol", text("ts"), *nums("buy_volume", "sell_volume"), "trades")


@query("stream_flush", "Z2", with_ctes("trades", f"""w AS (SELECT symbol, date_trunc('minute', trade_time) AS ts, {FLOW[0]} - {FLOW[1]} AS net FROM trades GROUP BY 1, 2)
 SELECT symbol, count(*) AS minutes, {qnum("sum(net)", "net_volume", 3)} FROM w GROUP BY symbol"""))
def stream_flush(spark, d):
    """Every micro-batch is handed on sorted; the sink keeps them apart by epoch, so a repeated epoch is not counted twice."""
    base = shared_folder(spark, "flush")

    def sink(bars, epoch):
        bars.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    bars = st.minute_flow(landed(spark, d))
    st.flush(bars, sink, f"{base}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{base}/rows")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("minutes"), num(F.sum("delta"), 3).alias("net_volume"))


@query("stream_trade_messages", "S16", with_ctes("trades", f"""SELECT symbol, count(*) AS trades, {qnum("sum(quantity)", "quantity", 3)}, count(*) FILTER (is_buyer_maker) AS sells FROM trades GROUP BY symbol"""))
def stream_trade_messages(spark, d):
    """The events as message files (text lines), read by the message reader; lines that are no messages are left out."""
    t = b.trades(spark, d)
    fields = F.struct(
        F.unix_millis(F.col("trade_time").cast("timestamp")).alias("T"), F.col("quantity").cast("string").alias("q"), F.col("is_buyer_maker").alias("m"),
        F.col("symbol").alias("s"), F.col("price").cast("string").alias("p"))
    folder = shared_folder(spark, "messages")
    lines = t.select(F.explode(F.array(F.to_json(fields), F.lit("{broken"))).alias("value"))
    lines.repartition(3).write.text(folder)
    out = available_now(st.read_trade_files(spark, folder))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), num(F.sum("quantity"), 3).alias("quantity"), F.count_if("is_buyer_maker").alias("sells"))


@query("stream_without_repeats", "Z8", with_ctes("trades", """SELECT symbol, count(DISTINCT trade_id) AS trades FROM trades GROUP BY symbol"""))
def stream_without_repeats(spark, d):
    """Every trade arrives twice in its own file and again in the next one."""
    t = b.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("trade_time"), F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("again"))
    stream = arrivals(t, land(t, "trade_time", 4, F.col("again")))
    return available_now(st.without_repeats(stream, late="30 days")).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))


def last_mean(closes: list[float]) -> float:
    return 1.0 if closes[-1] > sum(closes[-20:]) / len(closes[-20:]) else 0.0


def price_stream(spark, d):
    return landed(spark, d).where(F.col("symbol") != END).select("symbol", F.col("trade_time").alias("ts"), (100 + F.col("quantity") / 10).alias("close"))


P = "PARTITION BY symbol ORDER BY trade_time"


@query("stream_trailing_signal", "Z3", with_ctes("trades", f"""s AS (SELECT *, row_number() OVER ({P}) AS rn, avg(price) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM trades)
 SELECT symbol, CAST(trade_time AS VARCHAR) AS ts, {qnum("CASE WHEN price > m + 1e-9 THEN 1 ELSE 0 END", "signal")} FROM s WHERE rn >= 20"""))
def stream_trailing_signal(spark, d):
    out = available_now(st.trailing_signal(price_stream(spark, d), last_mean, size=50, warm=20))
    return out.select("symbol", text("ts"), num("signal").alias("signal"))


@query("stream_asof_enrich", "Z6 J1", with_ctes("trades", f"""SELECT a.symbol, CAST(a.trade_time AS VARCHAR) AS ts, {qnum("b.quantity", "side_value")} FROM (SELECT * FROM trades WHERE trade_id % 4 > 0) a
 ASOF LEFT JOIN (SELECT * FROM trades WHERE trade_id % 4 = 0) b ON a.symbol = b.symbol AND a.trade_time >= b.trade_time"""))
def stream_asof_enrich(spark, d):
    """The side rows arrive one file later than the prices of their time."""
    t = landed(spark, d, delay=F.when(F.col("trade_id") % 4 == 0, 1).otherwise(0))
    prices = t.where(F.coalesce(F.col("trade_id") % 4 > 0, F.lit(True))).select("symbol", F.col("trade_time").alias("ts"), F.coalesce("quantity", F.lit(0.0)).alias("close"))
    side = t.where("trade_id % 4 = 0").select("symbol", F.col("trade_time").alias("ts"), F.col("quantity").alias("value"))
    out = available_now(st.asof_enrich(prices, side, late="30 days")).where(F.col("symbol") != END)
    return out.select("symbol", text("ts"), num("side_value").alias("side_value"))
