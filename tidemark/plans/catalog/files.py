"""Files in and out: the given tables landed as files of the shared folder, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.catalog.tables import exchange_lines
from tidemark.plans.registry import num, qnum, query, with_ctes
from tidemark.sources import bindings as b
from tidemark.sources import readers, sinks
from tidemark.streaming.run import shared_folder


@query("ticker_csv_files", "S3 S5", with_ctes("bars slow", f"""SELECT 'T' || symbol AS symbol, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_day, {qnum("sum(close)", "total", 3)}
 FROM bars WHERE symbol IN (SELECT symbol FROM slow) GROUP BY symbol"""))
def ticker_csv_files(spark, d):
    folder = shared_folder(spark, "tickers")
    rows = b.bars(spark, d).select(F.concat(F.lit("t"), "symbol").alias("file"), "ts", "close", "volume")
    rows.repartition("file").write.option("header", True).partitionBy("file").csv(folder)
    # only the files of tickers that the second source has are opened: one name per ticker reaches the driver
    listed = b.slow_series(spark, d).select(F.concat(F.lit("t"), "symbol").alias("file")).intersect(rows.select("file"))
    files = readers.read_ticker_csvs(spark, folder, [r.file for r in listed.toLocalIterator()], folders=True)
    return files.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).cast("string").alias("first_day"), num(F.sum(F.col("close").cast("double")), 3).alias("total"))


def article_files(spark, d):
    """A folder of articles as JSON lines; every seventh line lost its closing brace, as a truncated download does."""
    line = F.to_json(F.struct(F.col("date").cast("string").alias("Date"), F.col("ticker").alias("Stock_symbol"), F.col("summary").alias("Article"), F.col("title").alias("Article_title")))
    lines = b.news(spark, d).withColumn("value", line)
    broken = F.expr("substring(value, 1, length(value) - 1)")
    folder = shared_folder(spark, "articles")
    lines.select(F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.col("value")).alias("value")).write.text(folder)
    return folder


@query("article_files", "S4", with_ctes("news", """SELECT ticker AS symbol, CAST(date AS VARCHAR) AS date, title, length(summary)::BIGINT AS chars FROM news WHERE doc_id % 7 <> 0"""))
def articles(spark, d):
    rows = readers.read_articles(spark, article_files(spark, d), "part-*")
    return rows.select(F.col("Stock_symbol").alias("symbol"), F.col("Date").alias("date"), F.col("Article_title").alias("title"), F.length("Article").cast("long").alias("chars"))


@query("json_articles_rejects", "S4 S17 D10", """SELECT symbol, count(*) FILTER (NOT bad) AS parsed, count(*) FILTER (bad) AS rejected FROM
 (SELECT CAST(doc_id % 100 AS VARCHAR) AS symbol, doc_id % 7 = 0 AS bad FROM documents) GROUP BY symbol""")
def json_articles_rejects(spark, d):
    good, bad = readers.read_articles_with_rejects(spark, article_files(spark, d), "part-*")
    lost = bad.select(F.regexp_extract("line", '"Stock_symbol":"([^"]*)"', 1).alias("symbol"), F.lit(True).alias("bad"))
    rows = good.select(F.col("Stock_symbol").alias("symbol"), F.lit(False).alias("bad")).unionByName(lost)
    return rows.groupBy("symbol").agg(F.count_if(~F.col("bad")).alias("parsed"), F.count_if("bad").alias("rejected"))


@query("exchange_year_cache", "S6 S7", """WITH l AS (SELECT l_linenumber = 7 AS other, l_linenumber % 3 AS lot, 'T' || l_suppkey AS ticker, year(l_shipdate) AS year,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
 k AS (SELECT DISTINCT 'T' || s_suppkey AS ticker FROM supplier WHERE s_acctbal > 0)
 SELECT ticker, year, count(*) AS n, CAST(sum(q) AS BIGINT) AS quantity, round(sum(cents) / 100, 2) AS turnover FROM l
 WHERE NOT other AND lot IN (0, 1) AND year > (SELECT min(year) FROM l) AND ticker IN (SELECT ticker FROM k) GROUP BY ticker, year""")
def exchange_year_cache(spark, d):
    landed, cache = shared_folder(spark, "exchange"), shared_folder(spark, "exchange-cache")
    lines = exchange_lines(spark, d)
    lines.write.partitionBy("year").option("encoding", "ISO-8859-1").text(landed)
    years = sorted(r.year for r in lines.select("year").distinct().toLocalIterator())  # one row per year
    history = readers.read_exchange_history(spark, [f"{landed}/year={y}" for y in years])
    history.withColumn("year", F.year("trade_date")).repartition("year").write.partitionBy("year").parquet(cache)
    listed = b.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"))
    rows = readers.read_exchange_range(spark, cache, years[1:]).join(listed, "ticker", "left_semi")
    return rows.groupBy("ticker", F.col("year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("turnover").cast("double").alias("turnover"))


@query("filings_latin1", "S8", """SELECT 'Relatório ' || o_orderpriority AS category, count(*) AS n, count(DISTINCT o_custkey) AS companies, round(sum(o_totalprice), 2) + 0.0 AS total
 FROM orders GROUP BY 1""")
def filings_latin1(spark, d):
    folder = shared_folder(spark, "filings")
    rows = b.table(spark, d, "orders").select(F.col("o_custkey").alias(" cnpj_cia "), F.concat(F.lit("Relatório "), "o_orderpriority").alias("Categ"),
                                              F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Valor "))
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(folder)
    f = readers.read_filings(spark, folder)
    return f.groupBy(F.col("CATEG").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("CNPJ_CIA").alias("companies"),
                                                           F.round(F.sum(F.col("VALOR").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("result_sets", "S12", with_ctes("bars", f"""SELECT 'parquet' AS format, symbol, count(*) AS n, {qnum("sum(close)", "total", 3)} FROM bars GROUP BY symbol
 UNION ALL SELECT 'csv', symbol, count(*), {qnum("sum(close)", "total", 3)} FROM bars GROUP BY symbol"""))
def result_sets(spark, d):
    bars = b.bars(spark, d).select("symbol", "ts", "close")
    found = None
    for kind in ("parquet", "csv"):
        path = sinks.save_results(shared_folder(spark, "results"), {"bars": bars}, kind)["bars"]
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)
        part = back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), num(F.sum(F.col("close").cast("double")), 3).alias("total")).withColumn("format", F.lit(kind))
        found = part if found is None else found.unionByName(part)
    return found


@query("partition_overwrite", "S13", with_ctes("bars", f"""g AS (SELECT min(asset_group) AS redone FROM bars)
 SELECT asset_group, symbol, count(*) AS n, {qnum("sum(CASE WHEN asset_group = redone THEN 2 ELSE 1 END * close)", "total", 3)}
 FROM bars, g GROUP BY asset_group, symbol"""))
def partition_overwrite(spark, d):
    path = shared_folder(spark, "tree")
    bars = b.bars(spark, d).select("asset_group", "symbol", "ts", "close")
    sinks.save_partitioned(bars, path)
    redone = bars.join(F.broadcast(bars.agg(F.min("asset_group").alias("asset_group"))), "asset_group", "left_semi")  # one row
    sinks.save_partitioned(redone.withColumn("close", 2 * F.col("close")), path, only_present=True)
    return readers.read_partitioned(spark, path).groupBy("asset_group", "symbol").agg(F.count(F.lit(1)).alias("n"), num(F.sum("close"), 3).alias("total")).withColumn("symbol", F.col("symbol").cast("string"))


@query("run_snapshots", "S14 S15", """WITH s AS (SELECT o_orderpriority AS run_id, CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1, 2),
 r AS (SELECT max(run_id) AS run_id FROM s)
 SELECT run_id, CAST(day AS VARCHAR) AS day, orders, row_number() OVER (ORDER BY day) AS step FROM s JOIN r USING (run_id)""")
def run_snapshots(spark, d):
    path = shared_folder(spark, "snapshots")
    orders = b.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run_id"), F.to_date("o_orderdate").alias("ts"))
    days = orders.groupBy("run_id", "ts").agg(F.count(F.lit(1)).alias("orders"))
    early = days.where(F.year("ts") % 2 == 0)
    sinks.append(early, path)
    sinks.append(days.exceptAll(early), path)
    last = orders.agg(F.max("run_id")).first()[0]
    found = sinks.run_snapshots(spark.read.parquet(path), last)
    step = F.row_number().over(Window.orderBy("ts"))  # one row per day of one run
    return found.select("run_id", F.col("ts").cast("string").alias("day"), "orders", step.cast("long").alias("step"))
