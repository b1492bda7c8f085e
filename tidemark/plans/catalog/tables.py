"""Sources, cleaning, fills, filters, joins, aggregates and cross-sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cleaning as cl
from tidemark.operators import aggregates as agg
from tidemark.operators import crosssection as xs
from tidemark.operators import joins
from tidemark.operators import quantiles
from tidemark.operators import tables as tb
from tidemark.operators.series import BARS, Axis, checked, following, pct_change, prev, windowed
from tidemark.plans.registry import num, nums, qnum, qnums, query, text, with_ctes
from tidemark.sources import bindings as b
from tidemark.sources import readers, sinks

P = "PARTITION BY symbol ORDER BY ts"
SEL = "SELECT symbol, CAST(ts AS VARCHAR) AS ts"


def returns(spark, d):
    return windowed(b.bars(spark, d), lambda x, a: x.withColumn("ret", pct_change("close", a)), lookback=1)


def exchange_lines(spark, d):
    """Fixed-width records of the line items, and their year."""
    li = b.table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    parts = {
        "record_type": F.when(F.col("l_linenumber") == 7, "99").otherwise("01"),
        "trade_date": F.date_format("l_shipdate", "yyyyMMdd"),
        "bdi_code": F.when(F.col("l_linenumber") % 3 == 0, "02").when(F.col("l_linenumber") % 3 == 1, "12").otherwise("10"),
        "ticker": F.concat(F.lit("T"), F.col("l_suppkey").cast("string")),
        "close": cents, "turnover": cents, "quantity": F.col("l_quantity").cast("long").cast("string"),
    }
    numeric = {n for n in readers.EXCHANGE_PRICES} | {"quantity", "trades"}
    line = F.concat(*[
        F.lpad(parts.get(n, F.lit("0")), w, "0") if n in numeric else F.rpad(parts.get(n, F.lit("")), w, " ")
        for n, w in readers.EXCHANGE_LAYOUT
    ])
    return li.select(line.alias("value"), F.year("l_shipdate").alias("year"))


@query("exchange_fixed_width", "S6 S7", """WITH l AS (SELECT CASE WHEN l_linenumber = 7 THEN '99' ELSE '01' END AS rt,
 CASE l_linenumber % 3 WHEN 0 THEN '02' WHEN 1 THEN '12' ELSE '10' END AS bdi, 'T' || l_suppkey AS ticker, l_shipdate,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT ticker, strftime(l_shipdate, '%Y-%m-%d') AS trade_date, count(*) AS n, CAST(sum(q) AS BIGINT) AS quantity,
 round(sum(cents) / 100, 2) AS turnover FROM l WHERE rt = '01' AND bdi IN ('02', '12') GROUP BY ALL""")
def exchange_fixed_width(spark, d):
    rows = readers.parse_exchange_lines(exchange_lines(spark, d))
    return rows.groupBy("ticker", F.col("trade_date").cast("string").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("turnover").cast("double").alias("turnover"))


@query("ticker_universe", "S5 U2", with_ctes("bars slow news", "SELECT symbol FROM bars INTERSECT SELECT ticker FROM news"))
def ticker_universe(spark, d):
    return readers.ticker_universe(b.bars(spark, d), b.news(spark, d).withColumnRenamed("ticker", "symbol"))


@query("universe_difference", "J11 U2 J10", with_ctes("bars slow", """SELECT symbol, CAST(ts AS VARCHAR) AS ts FROM bars
 EXCEPT SELECT symbol, CAST(ts AS VARCHAR) FROM slow"""))
def universe_difference(spark, d):
    return b.bars(spark, d).select("symbol", "ts").join(b.slow_series(spark, d), ["symbol", "ts"], "left_anti").select("symbol", text("ts"))


@query("conform_and_coerce", "P1 P2 P3 S1 S2 S11", """SELECT CAST(o_custkey AS VARCHAR) AS symbol, count(*) AS n,
 """ + qnum("sum(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END)", "total", 2) + """
 FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1""")
def conform_and_coerce(spark, d):
    raw = b.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("Ticker"), F.col("o_orderdate").cast("string").alias("TimeStamp"),
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("CLOSE "))
    bars = tb.conform(raw, readers.BAR_ALIASES, ("symbol", "ts", "close"))
    clean = tb.clean_bars(bars)
    return clean.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), num(F.sum("close"), 2).alias("total"))


@query("fills", "P4 P5 P6 P7", with_ctes("bars", f"""g AS (SELECT symbol, ts, CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS x FROM bars),
 f AS (SELECT *, last_value(x IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING) AS ff,
  first_value(x IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf,
  avg(x) OVER (PARTITION BY ts) AS dm, avg(x) OVER (PARTITION BY symbol) AS cm FROM g)
 {SEL}, {qnum("ff", "forward")}, {qnum("coalesce(ff, bf)", "forward_then_back")}, {qnum("coalesce(x, 0)", "zero")},
 {qnum("coalesce(x, dm, 0)", "date_mean")}, {qnum("coalesce(x, cm)", "column_mean")} FROM f"""))
def fills(spark, d):
    x = F.when(F.col("volume") % 3 != 0, F.col("close"))
    df = b.bars(spark, d).select("symbol", "ts", x.alias("x"), x.alias("forward"), x.alias("back"), x.alias("date_mean"), x.alias("column_mean"))
    ax = checked(df)
    df = tb.forward_fill(df, ["forward"], ax)
    df = tb.backward_fill(df, ["back"], ax)
    df = tb.group_mean_fill(df, "column_mean", ["symbol"])
    df = tb.group_mean_fill(df, "date_mean", ["ts"])
    df = df.withColumn("forward_then_back", F.coalesce("forward", "back")).fillna({"x": 0.0}).withColumnRenamed("x", "zero")
    return df.select("symbol", text("ts"), *nums("forward", "forward_then_back", "zero", "date_mean", "column_mean"))


@query("interpolate_gaps", "P27", with_ctes("bars", f"""g AS (SELECT symbol, ts, row_number() OVER ({P}) AS p, CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS x FROM bars),
 f AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0,
  first_value(x IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER z AS p1 FROM g
  WINDOW a AS ({P} ROWS UNBOUNDED PRECEDING), z AS ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 {SEL}, {qnum("coalesce(x, v0 + (p - p0) * (v1 - v0) / nullif(p1 - p0, 0), v0, v1)", "filled")} FROM f"""))
def interpolate_gaps(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", F.when(F.col("volume") % 3 != 0, F.col("close")).alias("filled"))
    return tb.interpolate(df, "filled", checked(df)).select("symbol", text("ts"), num("filled").alias("filled"))


@query("keep_last_duplicate", "P8 P9 U3", """SELECT CAST(o_custkey AS VARCHAR) AS symbol, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS order_id,
 """ + qnum("arg_max(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0'))", "price", 2) + " FROM orders GROUP BY o_custkey")
def keep_last_duplicate(spark, d):
    o = b.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return tb.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderkey").alias("order_id"), num("o_totalprice", 2).alias("price"))


@query("source_priority", "U1 U3", with_ctes("bars slow", """u AS (SELECT symbol, ts, close AS price, 'bars' AS source, 0 AS r FROM bars
 UNION ALL SELECT symbol, ts, value, 'slow', 1 FROM slow)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, arg_min(source, r) AS source, """ + qnum("arg_min(price, r)", "price", 4) + " FROM u GROUP BY symbol, ts"))
def source_priority(spark, d):
    first = b.bars(spark, d).select("symbol", "ts", F.col("close").alias("price"), F.lit("bars").alias("source"))
    second = b.slow_series(spark, d).select("symbol", "ts", F.col("value").alias("price"), F.lit("slow").alias("source"))
    return readers.by_priority([first, second], ["symbol", "ts"]).select("symbol", text("ts"), "source", num("price", 4).alias("price"))


@query("upsert_latest", "S14 S15", """WITH u AS (SELECT o_custkey AS id, o_orderstatus AS status, o_totalprice AS v, o_orderkey AS seq FROM orders
 UNION ALL SELECT o_custkey, 'X', o_totalprice + 1, o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'F')
 SELECT id, arg_max(status, seq) AS status, """ + qnum("arg_max(v, seq)", "v", 2) + " FROM u GROUP BY id")
def upsert_latest(spark, d):
    o = b.table(spark, d, "orders")
    now = o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    changes = o.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("id"), F.lit("X").alias("status"), (F.col("o_totalprice") + 1).alias("v"), (F.col("o_orderkey") + 1000000000).alias("seq"))
    return sinks.upsert(now, changes, ["id"], ["seq"]).select("id", "status", num("v", 2).alias("v"))


@query("guarded_arithmetic", "P10 P11 P12", """SELECT event_id, """ + qnum("CASE WHEN value > 5 AND event_id % 10 > 0 THEN ln(value / (event_id % 10)) END", "log_ratio") + ", "
 + qnum("value / nullif(event_id % 10, 0)", "quotient") + ", " + qnum("greatest(20, least(80, value))", "clipped") + " FROM events")
def guarded_arithmetic(spark, d):
    e = b.table(spark, d, "events").withColumn("m", (F.col("event_id") % 10).cast("double"))
    lr = cl.finite(cl.safe_log_ratio(F.when(F.col("value") > 5, F.col("value")), "m"))
    return e.select("event_id", num(lr).alias("log_ratio"), num(cl.ratio("value", "m")).alias("quotient"), num(cl.clip("value", 20.0, 80.0)).alias("clipped"))


@query("compound_filter", "P13 P14", """SELECT l_orderkey, l_linenumber, l_partkey, """ + qnum("l_extendedprice", "price", 2) + """ FROM lineitem
 WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND l_discount >= 0.05 AND l_quantity < 24""")
def compound_filter(spark, d):
    li = b.table(spark, d, "lineitem")
    keep = tb.every(
        F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")),
        F.col("l_discount") >= 0.05, F.col("l_quantity") < 24, None)
    return li.where(keep).select("l_orderkey", "l_linenumber", "l_partkey", num("l_extendedprice", 2).alias("price"))


@query("session_filter", "P15", """SELECT event_id, event_type FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 + 15 AND 960 - 15""")
def session_filter(spark, d):
    return b.table(spark, d, "events").where(tb.in_session("ts", 570, 960, 15)).select("event_id", "event_type")


@query("min_history_filter", "P16", with_ctes("bars", """SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 530"""))
def min_history_filter(spark, d):
    return tb.min_history(b.bars(spark, d), ["symbol"], 530).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("common_date_range", "P17", with_ctes("bars", """r AS (SELECT max(a) AS lo, min(z) AS hi FROM (SELECT min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol))
 SELECT symbol, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM bars, r WHERE ts BETWEEN lo AND hi GROUP BY symbol"""))
def common_date_range(spark, d):
    df = tb.common_range(b.bars(spark, d), "symbol", "ts")
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"))


@query("calendar_completion", "P18 P5", with_ctes("bars", f"""s AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol),
 g AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM s)
 SELECT g.symbol, CAST(g.ts AS VARCHAR) AS ts, b.close IS NOT NULL AS traded,
 {qnum("last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING)", "close")} FROM g LEFT JOIN bars b USING (symbol, ts)"""))
def calendar_completion(spark, d):
    df = tb.calendar_complete(b.bars(spark, d).select("symbol", "ts", "close"), "symbol", "ts").withColumn("traded", F.col("close").isNotNull())
    return tb.forward_fill(df, ["close"], checked(df)).select("symbol", text("ts"), "traded", num("close").alias("close"))


@query("cross_section_zscore", "P19", with_ctes("bars nb", f"""m AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS m, stddev_samp(ret) OVER (PARTITION BY ts) AS s FROM nb WHERE ret IS NOT NULL)
 {SEL}, {qnum("CASE WHEN s > 0 THEN greatest(-1.5, least(1.5, (ret - m) / s)) END", "z")} FROM m"""))
def cross_section_zscore(spark, d):
    df = xs.zscore(returns(spark, d).where("ret IS NOT NULL"), "ret", ["ts"], "z", 1.5)
    return df.select("symbol", text("ts"), num("z").alias("z"))


@query("train_standardise", "P19 P20", with_ctes("bars", f"""k AS (SELECT *, dense_rank() OVER (ORDER BY ts) <= floor((SELECT count(DISTINCT ts) FROM bars) * 0.7::DOUBLE) AS is_train FROM bars),
 m AS (SELECT avg(volume) AS m, stddev_pop(volume) AS s FROM k WHERE is_train)
 {SEL}, is_train, {qnum("(volume - m) / s", "z")} FROM k, m"""))
def train_standardise(spark, d):
    df = tb.time_split(b.bars(spark, d).select("symbol", "ts", "volume"), "ts", 0.7)
    m = df.where("is_train").agg(F.avg("volume").alias("m"), F.stddev_pop("volume").alias("s"))
    out = df.join(F.broadcast(m))  # one row: the train mean and deviation
    return out.select("symbol", text("ts"), "is_train", num((F.col("volume") - F.col("m")) / F.col("s")).alias("z"))


WIDE = range(1, 8)  # line numbers of an order


@query("wide_to_long", "P21 S9 D16", "SELECT CAST(l_orderkey AS VARCHAR) AS series_id, step, " + qnum("value", "value") + " FROM (SELECT l_orderkey, "
 + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS v{i}" for i in WIDE) + f""" FROM lineitem GROUP BY l_orderkey),
 LATERAL (SELECT unnest({[i - 1 for i in WIDE]}) AS step, unnest([{", ".join(f"v{i}" for i in WIDE)}]) AS value) WHERE value IS NOT NULL""")
def wide_to_long(spark, d):
    li = b.table(spark, d, "lineitem")
    wide = li.groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"v{i}") for i in WIDE])
    long = tb.to_long(wide.withColumn("series_id", F.col("l_orderkey").cast("string")), ["series_id"], [f"v{i}" for i in WIDE])
    return long.select("series_id", "step", num("value").alias("value"))


@query("sorted_top_k", "P22 P23", """SELECT o_orderkey, o_custkey, """ + qnum("o_totalprice", "price", 2) + " FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def sorted_top_k(spark, d):
    o = b.table(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)
    return o.select("o_orderkey", "o_custkey", num("o_totalprice", 2).alias("price"))


@query("last_rows_per_symbol", "P24", with_ctes("bars", f"""{SEL}, {qnum("close", "close")} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 16"""))
def last_rows_per_symbol(spark, d):
    return tb.last_rows(b.bars(spark, d), BARS, 16).select("symbol", text("ts"), num("close").alias("close"))


@query("best_by_universe", "P24 A10", with_ctes("bars", """v AS (SELECT asset_group, symbol, sum(volume) AS vol FROM bars GROUP BY ALL)
 SELECT asset_group, arg_max(symbol, vol * 1000000 - CAST(symbol AS INTEGER)) AS symbol, """ + qnum("max(vol)", "volume") + " FROM v GROUP BY asset_group"))
def best_by_universe(spark, d):
    v = b.bars(spark, d).groupBy("asset_group", "symbol").agg(F.sum("volume").alias("vol"))
    return v.groupBy("asset_group").agg(F.max_by("symbol", F.struct("vol", -F.col("symbol").cast("int"))).alias("symbol"), num(F.max("vol")).alias("volume"))


@query("first_tickers", "P25", with_ctes("bars", """SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 44) GROUP BY symbol"""))
def first_tickers(spark, d):
    return tb.first_groups(b.bars(spark, d), "symbol", 44).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("symbol_resolution", "P26", """WITH w AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'P' || p_partkey || '-X' WHEN 2 THEN 'P' || p_partkey || '/X' ELSE 'Q' || p_partkey END AS symbol,
   CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey || '.SA' WHEN 1 THEN 'P' || p_partkey || '/X' WHEN 2 THEN 'P' || p_partkey || '-X' END AS want FROM part)
 SELECT symbol, want AS resolved FROM w""")
def symbol_resolution(spark, d):
    p = b.table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey")).alias("s"))
    m = F.col("p_partkey") % 4
    wanted = p.select(F.when(m == 0, F.col("s")).when(m == 1, F.concat("s", F.lit("-X"))).when(m == 2, F.concat("s", F.lit("/X"))).otherwise(F.concat(F.lit("Q"), F.col("p_partkey"))).alias("symbol"))
    listed = p.select(F.when(m == 0, F.concat("s", F.lit(".SA"))).when(m == 1, F.concat("s", F.lit("/X"))).when(m == 2, F.concat("s", F.lit("-X"))).alias("symbol")).dropna()
    return tb.resolve_symbols(wanted, listed)


QUANTILE_SHARES = [0.01, 0.25, 1 / 3, 0.5, 0.95, 0.999]


def _quantile_sql(by: str) -> str:
    cells = ", ".join(qnum(f"quantile_cont(close, {s!r}::DOUBLE)", f"q{i}") for i, s in enumerate(QUANTILE_SHARES))
    return f"SELECT {by} AS of_group, {cells} FROM bars GROUP BY 1"


@query("exact_quantiles", "P28 A11", with_ctes("bars", _quantile_sql("asset_group") + " UNION ALL " + _quantile_sql("'all'")))
def exact_quantiles(spark, d):
    bars = b.bars(spark, d).select(F.col("asset_group").alias("of_group"), "close")
    whole = quantiles.exact_quantiles(bars, "close", QUANTILE_SHARES).withColumn("of_group", F.lit("all"))
    found = quantiles.exact_quantiles(bars, "close", QUANTILE_SHARES, ["of_group"]).unionByName(whole)
    return found.select("of_group", *[num(F.col("quantiles")[i]).alias(f"q{i}") for i in range(len(QUANTILE_SHARES))])


@query("winsorise_quantiles", "P28 A11", with_ctes("bars", f"""q AS (SELECT symbol, quantile_cont(volume, 0.05) AS lo, quantile_cont(volume, 0.95) AS hi FROM bars GROUP BY symbol)
 {SEL}, {qnum("greatest(lo, least(hi, volume))", "volume")} FROM bars JOIN q USING (symbol)"""))
def winsorise_quantiles(spark, d):
    return tb.winsorise(b.bars(spark, d).select("symbol", "ts", "volume"), "volume", by=["symbol"]).select("symbol", text("ts"), num("volume").alias("volume"))


# --- joins -----------------------------------------------------------------------------------


@query("asof_backward", "J1 J4 D7", with_ctes("bars slow", f"""SELECT b.symbol, CAST(b.ts AS VARCHAR) AS ts, CAST(s.ts AS VARCHAR) AS matched_ts, {qnum("s.value", "value", 2)}
 FROM bars b ASOF LEFT JOIN slow s ON b.symbol = s.symbol AND b.ts >= s.ts"""))
def asof_backward(spark, d):
    df = joins.asof_join(b.bars(spark, d).select("symbol", "ts", "close"), b.slow_series(spark, d))
    return df.select("symbol", text("ts"), text("matched_ts"), num("value", 2).alias("value"))


@query("asof_forward", "J2", with_ctes("bars news", f"""SELECT n.doc_id, CAST(b.ts AS VARCHAR) AS matched_ts, {qnum("b.close", "close")}
 FROM (SELECT doc_id, ticker AS symbol, date AS ts FROM news) n ASOF LEFT JOIN bars b ON n.symbol = b.symbol AND n.ts <= b.ts"""))
def asof_forward(spark, d):
    left = b.news(spark, d).select("doc_id", F.col("ticker").alias("symbol"), F.col("date").alias("ts"))
    df = joins.asof_join(left, b.bars(spark, d).select("symbol", "ts", "close"), direction="forward")
    return df.select("doc_id", text("matched_ts"), num("close").alias("close"))


@query("asof_tolerance", "J3", with_ctes("bars news", """j AS (SELECT n.doc_id, n.symbol, n.ts, b.ts AS m, b.close FROM (SELECT doc_id, ticker AS symbol, date AS ts FROM news) n
   ASOF LEFT JOIN bars b ON n.symbol = b.symbol AND n.ts >= b.ts)
 SELECT symbol, count(*) AS articles, count(*) FILTER (ts - m <= 5) AS aligned, """ + qnum("avg(CASE WHEN ts - m <= 5 THEN ts - m END)", "mean_days")
 + ", " + qnum("sum(CASE WHEN ts - m <= 5 THEN close END)", "close_sum") + " FROM j GROUP BY symbol"))
def asof_tolerance(spark, d):
    left = b.news(spark, d).select("doc_id", F.col("ticker").alias("symbol"), F.col("date").alias("ts"))
    df = joins.asof_join(left, b.bars(spark, d).select("symbol", "ts", "close"), tolerance_days=5)
    gap = F.date_diff("ts", "matched_ts")
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("articles"), F.count("matched_ts").alias("aligned"),
                                    num(F.avg(gap)).alias("mean_days"), num(F.sum("close")).alias("close_sum"))


@query("nearest_in_time", "J5", with_ctes("bars news", f"""n AS (SELECT doc_id, ticker AS symbol, date AS ts FROM news),
 p AS (SELECT n.doc_id, b.ts AS m, abs(n.ts - b.ts) AS gap FROM n JOIN bars b ON b.symbol = n.symbol),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, m) AS k FROM p)
 SELECT doc_id, CAST(m AS VARCHAR) AS matched_ts, CAST(gap * 86400 AS BIGINT) AS gap_seconds FROM n LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (doc_id)"""))
def nearest_in_time(spark, d):
    left = b.news(spark, d).select("doc_id", F.col("ticker").alias("symbol"), F.col("date").alias("ts"))
    df = joins.nearest_join(left, b.bars(spark, d).select("symbol", "ts", "close"))
    return df.select("doc_id", text("matched_ts"), F.col("gap_seconds").cast("long").alias("gap_seconds"))


@query("chained_left_joins", "J6 J7 J8 J9 J17", with_ctes("bars nb slow", f"""o AS (SELECT l_suppkey::VARCHAR AS symbol, avg(l_discount) AS iv FROM lineitem GROUP BY 1)
 SELECT nb.symbol, CAST(nb.ts AS VARCHAR) AS ts, {qnum("ret", "ret")}, {qnum("value", "value", 2)}, {qnum("iv", "iv")}
 FROM nb LEFT JOIN slow USING (symbol, ts) LEFT JOIN o USING (symbol)"""))
def chained_left_joins(spark, d):
    iv = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol")).agg(F.avg("l_discount").alias("iv"))
    df = returns(spark, d).join(b.slow_series(spark, d), ["symbol", "ts"], "left").join(iv, "symbol", "left")
    return df.select("symbol", text("ts"), num("ret").alias("ret"), num("value", 2).alias("value"), num("iv").alias("iv"))


@query("membership_flags", "J10", with_ctes("bars slow", """big AS MATERIALIZED (SELECT DISTINCT ts FROM slow WHERE value > 300000), busy AS MATERIALIZED (SELECT DISTINCT ts FROM bars WHERE volume > 150)
 SELECT symbol, CAST(bars.ts AS VARCHAR) AS ts, big.ts IS NOT NULL AS big, busy.ts IS NOT NULL AS busy, big.ts IS NOT NULL OR busy.ts IS NOT NULL AS any_flag
 FROM bars LEFT JOIN big ON big.ts = bars.ts LEFT JOIN busy ON busy.ts = bars.ts"""))
def membership_flags(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "volume")
    sets = {"big": b.slow_series(spark, d).where("value > 300000"), "busy": bars.where("volume > 150")}
    return joins.membership_flags(bars.select("symbol", "ts"), "ts", sets).select("symbol", text("ts"), "big", "busy", "any_flag")


@query("range_join_decay", "J12 J13", with_ctes("bars", """e AS (SELECT symbol, CAST(epoch(ts) / 86400 AS DOUBLE) AS t, volume FROM bars)
 SELECT a.symbol, a.t AS day, count(*) AS events, """ + qnum("sum(x.volume * exp(-0.1 * (a.t - x.t)))", "weighted") + """ FROM e a JOIN e x ON x.symbol = a.symbol AND x.t < a.t AND x.t >= a.t - 14
 GROUP BY a.symbol, a.t"""))
def range_join_decay(spark, d):
    e = b.bars(spark, d).select("symbol", F.unix_date("ts").cast("double").alias("t"), "volume")
    left = e.select("symbol", F.col("t").alias("day"))
    pairs = joins.range_join(left, e, ["symbol"], "day", "t", 14.0)
    w = F.col("volume") * F.exp(-0.1 * (F.col("day") - F.col("t")))
    return pairs.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("events"), num(F.sum(w)).alias("weighted"))


@query("lookup_enrich", "J15", """SELECT page_id, lower(regexp_replace(url, '[?&].*$', '')) AS url_key, """ + qnum("n", "n_pages") + """ FROM pages JOIN
 (SELECT lower(regexp_replace(url, '[?&].*$', '')) AS k, count(*) AS n FROM pages GROUP BY 1) ON k = lower(regexp_replace(url, '[?&].*$', ''))""")
def lookup_enrich(spark, d):
    key = F.lower(F.regexp_replace("url", r"[?&].*$", ""))
    pages = b.table(spark, d, "pages").select("page_id", key.alias("url_key"))
    side = pages.groupBy("url_key").agg(F.count(F.lit(1)).alias("n_pages"))
    return pages.join(side, "url_key", "left").select("page_id", "url_key", num("n_pages").alias("n_pages"))


# --- aggregation -----------------------------------------------------------------------------


@query("trade_buckets", "A1", with_ctes("trades", """SELECT symbol, CAST(time_bucket(INTERVAL 5 MINUTE, trade_time) AS VARCHAR) AS ts, count(*) AS trade_count, """
 + qnum("sum(quantity)", "total_qty") + ", " + qnum("sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END)", "buy_qty") + ", "
 + qnum("sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END)", "sell_qty") + ", " + qnum("sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END)", "trade_delta") + " FROM trades GROUP BY 1, 2"))
def trade_buckets(spark, d):
    from tidemark.operators.microstructure import trade_features

    df = trade_features(b.trades(spark, d), "5 minutes")
    return df.select("symbol", text("ts"), "trade_count", *nums("total_qty", "buy_qty", "sell_qty", "trade_delta"))


@query("volume_profile", "A2", with_ctes("trades", """m AS (SELECT min(price) AS lo, max(price) AS hi FROM trades),
 e AS (SELECT i, CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + i * (hi - lo) / 50 END AS edge FROM m, (SELECT unnest(range(51)) AS i)),
 b AS (SELECT a.i + 1 AS price_bin, a.edge AS lo, z.edge AS hi FROM e a JOIN e z ON z.i = a.i + 1)
 SELECT price_bin, """ + qnum("coalesce(sum(quantity), 0)", "volume", 3) + " FROM b LEFT JOIN trades t ON t.price > b.lo AND t.price <= b.hi GROUP BY price_bin"))
def volume_profile(spark, d):
    from tidemark.operators.microstructure import volume_profile as profile

    return profile(b.trades(spark, d), 50).select(F.col("price_bin").cast("long").alias("price_bin"), num("volume", 3).alias("volume"))


@query("daily_sentiment", "A3 A4 T17", with_ctes("sentiment", """SELECT ticker, CAST(date AS VARCHAR) AS date, """ + ", ".join(qnum(f"avg({c})", c) for c in ("positive", "negative", "neutral"))
 + ", count(*) AS n_headlines, count(*) FILTER (positive > negative) AS n_positive, count(*) FILTER (negative > positive) AS n_negative, "
 + qnum("(count(*) FILTER (positive > negative) - count(*) FILTER (negative > positive)) / count(*)", "balance") + " FROM sentiment GROUP BY ticker, date"))
def daily_sentiment(spark, d):
    s = b.sentiment(spark, d)
    up, down = F.count_if(F.col("positive") > F.col("negative")), F.count_if(F.col("negative") > F.col("positive"))
    daily = s.groupBy("ticker", "date").agg(*[num(F.avg(c)).alias(c) for c in ("positive", "negative", "neutral")], F.count(F.lit(1)).alias("n_headlines"),
                                            up.alias("n_positive"), down.alias("n_negative"), num((up - down) / F.count(F.lit(1))).alias("balance"))
    return daily.withColumn("date", text("date"))


@query("daily_documents", "A5", with_ctes("news", """SELECT ticker, CAST(date AS VARCHAR) AS date, count(*) AS articles, md5(string_agg(coalesce(summary, ''), ' ' ORDER BY doc_id)) AS digest,
 length(string_agg(coalesce(summary, ''), ' ' ORDER BY doc_id)) AS n_chars FROM news GROUP BY ticker, date"""))
def daily_documents(spark, d):
    docs = agg.grouped_documents(b.news(spark, d), ["ticker", "date"], "doc_id", "summary")
    return docs.select("ticker", text("date"), F.col("articles").cast("long").alias("articles"), F.md5("document").alias("digest"), F.length("document").cast("long").alias("n_chars"))


@query("vector_mean", "A6 S10 D11", with_ctes("emb", """SELECT day, i AS pos, """ + qnum("avg(x)", "mean") + """ FROM (SELECT day, unnest(range(len(emb))) AS i, unnest(emb)::DOUBLE AS x FROM emb) GROUP BY day, i"""))
def vector_mean(spark, d):
    m = agg.vector_mean(b.embeddings(spark, d), ["day"], "emb", "mean")
    return m.select("day", F.posexplode("mean").alias("pos", "mean")).select("day", F.col("pos").cast("long").alias("pos"), num("mean").alias("mean"))


@query("ticker_stats", "A8 A7 A9", with_ctes("bars nb", f"""e AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS eq FROM nb),
 dd AS (SELECT *, eq / max(eq) OVER ({P} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
 SELECT symbol, count(*) AS bars, {qnum("avg(ret) * 252", "annual_mean")}, {qnum("stddev_samp(ret) * sqrt(252)", "annual_vol")},
 {qnum("avg(ret) / stddev_samp(ret) * sqrt(252)", "sharpe")}, {qnum("min(dd)", "max_drawdown")}, {qnum("avg(volume)", "mean_volume")} FROM dd GROUP BY symbol"""))
def ticker_stats(spark, d):
    df = agg.ticker_stats(b.bars(spark, d))
    return df.select("symbol", "bars", *nums("annual_mean", "annual_vol", "sharpe", "max_drawdown", "mean_volume"))


@query("group_counts", "A9", with_ctes("bars", "SELECT asset_group, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT ts) AS dates FROM bars GROUP BY asset_group"))
def group_counts(spark, d):
    return b.bars(spark, d).groupBy("asset_group").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("ts").alias("dates"))


@query("describe_quantiles", "A11 A13", with_ctes("bars nb", f"""SELECT symbol, {", ".join(qnum(f"quantile_cont(ret, {q})", f"q{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95))},
 {qnum("skewness(ret)", "skew")}, {qnum("kurtosis(ret)", "kurt")}, {qnum("min(ret)", "worst")}, {qnum("max(ret)", "best")} FROM nb GROUP BY symbol"""))
def describe_quantiles(spark, d):
    df = agg.distribution(returns(spark, d), ["symbol"], "ret")
    return df.select("symbol", *nums("q05", "q25", "q50", "q75", "q95", "skew", "kurt", "worst", "best"))


BENCHMARKS = (0, 1, 2)


@query("pair_correlation", "A12", with_ctes("bars nb", f"""c AS (SELECT CAST(symbol AS INTEGER) AS symbol, date_trunc('week', ts) AS wk, avg(close) AS x FROM bars GROUP BY 1, 2)
 SELECT CAST(a.symbol AS VARCHAR) AS left_symbol, CAST(z.symbol AS VARCHAR) AS right_symbol, count(*) AS n, {qnum("covar_samp(a.x, z.x)", "cov")}, {qnum("corr(a.x, z.x)", "corr")}
 FROM c a JOIN c z ON a.wk = z.wk AND a.symbol IN {BENCHMARKS} GROUP BY a.symbol, z.symbol"""))
def pair_correlation(spark, d):
    weekly = b.bars(spark, d).groupBy(F.col("symbol").cast("int").alias("symbol"), F.date_trunc("week", "ts").alias("wk")).agg(F.avg("close").alias("x"))
    m = agg.comoments(weekly, "symbol", "wk", "x", BENCHMARKS)
    return m.select(F.col("left_key").cast("string").alias("left_symbol"), F.col("right_key").cast("string").alias("right_symbol"), "n", num("cov").alias("cov"), num("corr").alias("corr"))


@query("recent_covariance", "A12", with_ctes("bars nb", f"""c AS (SELECT CAST(symbol AS INTEGER) AS symbol, date_trunc('week', ts) AS wk, avg(close) AS x FROM bars GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY CAST(symbol AS INTEGER) ORDER BY date_trunc('week', ts) DESC) <= 252)
 SELECT CAST(a.symbol AS VARCHAR) AS left_symbol, CAST(z.symbol AS VARCHAR) AS right_symbol, count(*) AS n, {qnum("covar_samp(a.x, z.x)", "cov")} FROM c a JOIN c z ON a.wk = z.wk AND a.symbol IN {BENCHMARKS} GROUP BY a.symbol, z.symbol"""))
def recent_covariance(spark, d):
    weekly = b.bars(spark, d).groupBy(F.col("symbol").cast("int").alias("symbol"), F.date_trunc("week", "ts").alias("wk")).agg(F.avg("close").alias("x"))
    m = agg.comoments(weekly, "symbol", "wk", "x", BENCHMARKS, last=252)
    return m.select(F.col("left_key").cast("string").alias("left_symbol"), F.col("right_key").cast("string").alias("right_symbol"), "n", num("cov").alias("cov"))


@query("pivot_matrix", "A14", with_ctes("bars", "m AS (SELECT symbol, CAST(year(ts) AS VARCHAR) AS y, " + qnum("avg(close)", "v") + """ FROM bars GROUP BY symbol, year(ts))
 SELECT * FROM (PIVOT m ON y USING first(v) GROUP BY symbol)"""))
def pivot_matrix(spark, d):
    yearly = b.bars(spark, d).groupBy("symbol", F.year("ts").cast("string").alias("y")).agg(num(F.avg("close")).alias("v"))
    return yearly.groupBy("symbol").pivot("y").agg(F.first("v"))  # the years are those of the data


@query("calendar_resample", "A15", with_ctes("bars nb", f"""SELECT symbol, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, {qnum("arg_max(close, ts)", "last_close")},
 {qnum("exp(sum(ln(1 + coalesce(ret, 0)))) - 1", "compounded")}, {qnum("avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)", "hit_rate")} FROM nb GROUP BY symbol, date_trunc('month', ts)"""))
def calendar_resample(spark, d):
    r = agg.resample(returns(spark, d), ["symbol"], "month", "close", "ret")
    return r.select("symbol", F.to_date("period").cast("string").alias("month"), *nums("last_close", "compounded", "hit_rate"))


@query("contribution_share", "A17", with_ctes("bars", f"""t AS (SELECT symbol, sum(close * volume) AS v FROM bars GROUP BY symbol),
 s AS (SELECT symbol, v, sum(v) OVER (ORDER BY v DESC, symbol ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM t)
 SELECT symbol, {qnum("v", "contribution", 2)}, {qnum("cum", "cumulative_share")}, cum - v / (SELECT sum(v) FROM t) < 0.8 AS in_first_80 FROM s"""))
def contribution_share(spark, d):
    t = b.bars(spark, d).groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("v"))
    s = agg.cumulative_share(t, "symbol", "v", 0.8)
    return s.select("symbol", num("v", 2).alias("contribution"), num("cumulative_share").alias("cumulative_share"), F.col("in_first").alias("in_first_80"))


@query("universe_rollup", "A18", with_ctes("bars nb", f"""SELECT coalesce(asset_group, 'all_assets') AS universe, count(*) AS n, {qnum("avg(ret)", "mean_ret", 8)},
 {qnum("stddev_samp(ret) * sqrt(CASE WHEN asset_group = 'ASIA' THEN 365 ELSE 252 END)", "annual_vol")} FROM nb GROUP BY GROUPING SETS ((asset_group), ())"""))
def universe_rollup(spark, d):
    r = returns(spark, d).groupingSets([["asset_group"], []], "asset_group").agg(F.count(F.lit(1)).alias("n"), num(F.avg("ret"), 8).alias("mean_ret"), F.stddev_samp("ret").alias("sd"))
    year = F.when(F.col("asset_group") == "ASIA", F.lit(365.0)).otherwise(252.0)
    return r.select(F.coalesce("asset_group", F.lit("all_assets")).alias("universe"), "n", "mean_ret", num(F.col("sd") * F.sqrt(year)).alias("annual_vol"))


@query("t_statistics", "A19 A20", with_ctes("bars nb", f"""x AS (SELECT n.symbol, n.ret AS a, m.mkt AS b FROM nb n JOIN (SELECT ts, avg(ret) AS mkt FROM nb GROUP BY ts) m USING (ts) WHERE n.ret IS NOT NULL AND m.mkt IS NOT NULL)
 SELECT symbol, count(*) AS n, {qnum("(avg(a) - avg(b)) / sqrt(((count(*) - 1) * var_samp(a) + (count(*) - 1) * var_samp(b)) / (2 * count(*) - 2) * (2.0::DOUBLE / count(*)))", "t_equal_var")},
 {qnum("avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))", "t_paired")}, {qnum("avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END)", "win_rate")} FROM x GROUP BY symbol"""))
def t_statistics(spark, d):
    r = returns(spark, d).where("ret IS NOT NULL")
    df = xs.per_group(r, ["ts"], {"mkt": F.avg("ret")})
    t = agg.t_tests(df, ["symbol"], "ret", "mkt")
    return t.select("symbol", "n", *nums("t_equal_var", "t_paired", "win_rate"))


@query("news_day_ranking", "A21 P23", with_ctes("news", """SELECT ticker, count(DISTINCT date) AS days, row_number() OVER (ORDER BY count(DISTINCT date) DESC, ticker) AS rank FROM news GROUP BY ticker ORDER BY days DESC, ticker LIMIT 50"""))
def news_day_ranking(spark, d):
    days = b.news(spark, d).groupBy("ticker").agg(F.countDistinct("date").alias("days"))
    top = days.orderBy(F.desc("days"), "ticker").limit(50)
    # the ranking runs over the 50 rows of the report
    return top.select("ticker", "days", F.row_number().over(Window.orderBy(F.desc("days"), "ticker")).cast("long").alias("rank"))


COVERED = """d AS (SELECT DISTINCT ticker AS symbol, date AS ts FROM news),
 cv AS (SELECT b.symbol, count(*) AS trading_days, count(d.ts) AS news_days, 100.0::DOUBLE * count(d.ts) / count(*) AS pct FROM bars b LEFT JOIN d USING (symbol, ts) GROUP BY b.symbol)"""


def covered(spark, d):
    from tidemark.operators.news import news_day_coverage

    return news_day_coverage(b.bars(spark, d), b.news(spark, d).select(F.col("ticker").alias("symbol"), F.col("date").alias("ts")))


@query("news_coverage", "A22", with_ctes("bars news", f"""{COVERED} SELECT symbol, trading_days, news_days, {qnum("pct", "coverage_pct")} FROM cv"""))
def news_coverage(spark, d):
    return covered(spark, d).select("symbol", "trading_days", "news_days", *nums("coverage_pct"))


@query("news_coverage_summary", "A22", with_ctes("bars news", f"""{COVERED} SELECT count(*) AS tickers, count(*) FILTER (pct = 0) AS without_news, {qnum("avg(pct)", "mean_pct")}, {qnum("quantile_cont(pct, 0.5)", "median_pct")},
 {qnum("min(pct)", "lowest_pct")}, {qnum("max(pct)", "highest_pct")}, {qnum("max(pct) - min(pct)", "range_pct")} FROM cv"""))
def news_coverage_summary(spark, d):
    from tidemark.operators.news import coverage_summary

    return coverage_summary(covered(spark, d)).select("tickers", "without_news", *nums("mean_pct", "median_pct", "lowest_pct", "highest_pct", "range_pct"))


# --- cross-sections, ranks, islands ----------------------------------------------------------


@query("percentile_ranks", "W12 W13", with_ctes("bars", f"""{SEL}, {qnum("(rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2) / count(volume) OVER (PARTITION BY ts)", "rank_date")},
 {qnum("(rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2) / count(volume) OVER (PARTITION BY symbol)", "rank_sample")} FROM bars"""))
def percentile_ranks(spark, d):
    df = xs.pct_rank(b.bars(spark, d).select("symbol", "ts", "volume"), "volume", ["ts"], "rank_date")
    return xs.pct_rank(df, "volume", ["symbol"], "rank_sample").select("symbol", text("ts"), *nums("rank_date", "rank_sample"))


@query("dense_rank_bins", "W14 W15", with_ctes("bars", """s AS (SELECT symbol, asset_group, sum(volume) AS v FROM bars GROUP BY ALL),
 e AS (SELECT quantile_cont(v, [0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS e FROM s)
 SELECT symbol, dense_rank() OVER (PARTITION BY asset_group ORDER BY v DESC) AS rank, CAST(greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) AS INTEGER) AS bin FROM s, e"""))
def dense_rank_bins(spark, d):
    s = b.bars(spark, d).groupBy("symbol", "asset_group").agg(F.sum("volume").alias("v"))
    s = s.withColumn("rank", F.dense_rank().over(Window.partitionBy("asset_group").orderBy(F.desc("v"))).cast("long"))
    return xs.quantile_bins(s, "v", 4, "bin").select("symbol", "rank", "bin")


@query("threshold_digitise", "W16", with_ctes("bars", f"""{SEL}, CASE WHEN close < 102 THEN 0 WHEN close < 105 THEN 1 WHEN close < 108 THEN 2 ELSE 3 END AS bin FROM bars"""))
def threshold_digitise(spark, d):
    return b.bars(spark, d).select("symbol", text("ts"), xs.digitize("close", [102, 105, 108]).alias("bin"))


@query("islands", "W17", with_ctes("bars nb", f"""s AS (SELECT *, CASE WHEN close >= 105 THEN 'high' ELSE 'low' END AS regime FROM nb),
 c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER ({P}) THEN 1 ELSE 0 END AS chg FROM s),
 i AS (SELECT *, sum(chg) OVER ({P} ROWS UNBOUNDED PRECEDING) AS island FROM c)
 SELECT symbol, CAST(island AS BIGINT) AS island, regime, count(*) AS bars, CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts FROM i GROUP BY symbol, island, regime"""))
def islands(spark, d):
    df = b.bars(spark, d).select("symbol", "ts", F.when(F.col("close") >= 105, "high").otherwise("low").alias("regime"))
    out = agg.islands(df, "regime")
    return out.select("symbol", "island", "regime", "bars", text("start_ts"), text("end_ts"))


@query("drawdown_episodes", "W17", with_ctes("bars nb", f"""e AS (SELECT *, close / max(close) OVER ({P} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nb),
 c AS (SELECT *, dd < 0 AS under, CASE WHEN (dd < 0) IS DISTINCT FROM lag(dd < 0) OVER ({P}) THEN 1 ELSE 0 END AS chg FROM e),
 i AS (SELECT *, sum(chg) OVER ({P} ROWS UNBOUNDED PRECEDING) AS island FROM c)
 SELECT symbol, CAST(min(ts) AS VARCHAR) AS start_ts, count(*) AS bars, {qnum("min(dd)", "depth")} FROM i WHERE under GROUP BY symbol, island"""))
def drawdown_episodes(spark, d):
    out = agg.drawdown_episodes(b.bars(spark, d).select("symbol", "ts", "close"), "close")
    return out.select("symbol", text("start_ts"), "bars", num("depth").alias("depth"))


@query("rebalance_mask", "W20", with_ctes("bars", f"""w AS (SELECT *, weekofyear(ts) * 10000 + year(ts) AS wk, month(ts) * 10000 + year(ts) AS mo FROM bars)
 {SEL}, coalesce(wk <> lag(wk) OVER ({P}), true) AS weekly, coalesce(mo <> lag(mo) OVER ({P}), true) AS monthly,
 isodow(ts) = 1 OR lag(ts) OVER ({P}) IS NULL AS on_monday FROM w"""))
def rebalance_mask(spark, d):
    from tidemark.operators.backtest import rebalance_mask as mask

    df = windowed(
        b.bars(spark, d).select("symbol", "ts"),
        lambda x, a: x.withColumns({"weekly": mask(a, "weekly"), "monthly": mask(a, "monthly"), "on_monday": mask(a, "weekly", 0)}), lookback=1)
    return df.select("symbol", text("ts"), "weekly", "monthly", "on_monday")
