from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.tables import conform
from tidemark.plans import catalog
from tidemark.sources import bindings as b
from tidemark.sources import readers, sinks


def test_bar_files_round_trip(spark, folder, tmp_path):
    bars = b.bars(spark, folder).where("symbol IN ('1', '2')").withColumnRenamed("ts", "Date")
    bars.coalesce(1).write.option("header", True).csv(str(tmp_path / "bars.csv"))
    bars.write.parquet(str(tmp_path / "bars.parquet"))
    for name in ("bars.csv", "bars.parquet"):
        got = readers.read_bars(spark, str(tmp_path / name))
        assert got.count() == bars.count() and got.schema["close"].dataType.typeName() == "double"
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        conform(bars, readers.BAR_ALIASES, ("missing",))


def test_ticker_csvs(spark, tmp_path):
    for name in ("aaa", "bbb", "ccc"):
        (tmp_path / f"{name}.csv").write_text("Date,Close\n2020-01-01,1\n2020-01-02,2\n")
    every = readers.read_ticker_csvs(spark, str(tmp_path))
    assert sorted(r[0] for r in every.select("symbol").distinct().collect()) == ["AAA", "BBB", "CCC"]
    assert readers.read_ticker_csvs(spark, str(tmp_path), ["bbb"]).count() == 2
    assert readers.read_ticker_csvs(spark, str(tmp_path), limit=2).count() == 4


def test_articles_and_rejects(spark, tmp_path):
    good = '{"Date": "2020-01-01", "Stock_symbol": "A", "Article": "x", "Article_title": "t", "Url": "u"}'
    (tmp_path / "a.jsonl").write_text(good + "\n" + good[:-1] + "\n" + good + "\n")
    assert readers.read_articles(spark, str(tmp_path)).count() == 2
    ok, bad = readers.read_articles_with_rejects(spark, str(tmp_path))
    assert ok.count() == 2 and bad.count() == 1


def test_filings_and_exchange_files(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(" cnpj_cia ; Categ\n1;Relat\xf3rio\n2;x\n".encode("latin-1"))
    f = readers.read_filings(spark, str(tmp_path / "f.csv"))
    assert f.columns == ["CNPJ_CIA", "CATEG"] and f.where("CATEG = 'Relatório'").count() == 1
    values = {"record_type": "01", "trade_date": "20200103", "bdi_code": "02", "ticker": "ABCD3", "close": "0000000001234", "quantity": "5"}
    numeric = {*readers.EXCHANGE_PRICES, "quantity", "trades"}
    line = "".join(values.get(n, "").rjust(w, "0") if n in numeric else values.get(n, "").ljust(w) for n, w in readers.EXCHANGE_LAYOUT)
    (tmp_path / "h.txt").write_text(line + "\n" + "99" + line[2:] + "\n", encoding="latin-1")
    rows = readers.read_exchange_history(spark, str(tmp_path / "h.txt")).collect()
    assert len(rows) == 1 and rows[0].ticker == "ABCD3" and float(rows[0].close) == 12.34 and str(rows[0].trade_date) == "2020-01-03"
    hist = readers.read_exchange_history(spark, str(tmp_path / "h.txt")).withColumn("year", F.year("trade_date"))
    hist.write.partitionBy("year").parquet(str(tmp_path / "hist"))
    assert readers.read_exchange_range(spark, str(tmp_path / "hist"), [2020], ["ABCD3"]).count() == 1
    assert readers.read_exchange_range(spark, str(tmp_path / "hist"), [2019]).count() == 0


def test_sinks(spark, folder, tmp_path):
    bars = b.bars(spark, folder)
    paths = sinks.save_results(str(tmp_path / "out"), {"bars": bars}, "parquet")
    assert spark.read.parquet(paths["bars"]).count() == bars.count()
    sinks.save_results(str(tmp_path / "csv"), {"bars": bars}, "csv")
    sinks.save_partitioned(bars, str(tmp_path / "tree"))
    assert spark.read.parquet(str(tmp_path / "tree")).select("symbol").distinct().count() == bars.select("symbol").distinct().count()
    assert spark.range(1).select(sinks.safe_name(F.lit("BTC/USD x"))).first()[0] == "BTC_USD_x"
    snaps = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "run_id string, ts int")
    sinks.append(snaps, str(tmp_path / "s"))
    sinks.append(snaps, str(tmp_path / "s"))
    assert [r.ts for r in sinks.run_snapshots(spark.read.parquet(str(tmp_path / "s")), "a").collect()] == [1, 1, 2, 2]


def test_tree_is_listed_by_few_tasks(spark, tmp_path):
    n, day = readers.LISTING_TASKS + 30, dt.datetime(2024, 1, 2)
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "a", 0), (1, "b", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, "s", i // n, 1.0) for i in range(n + 2)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "lineitem": ([(i, i, 1, 1.0, 1_000.0 + i, day) for i in range(n + 2)],
                     "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    sc, held = spark.sparkContext, spark.conf.get(readers.LISTING)
    sc.setJobGroup("tree", "tree")
    try:
        got = {r.symbol: (r.asset_group, r.n, r.total) for r in catalog.load().QUERIES["partition_overwrite"](spark, str(tmp_path)).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    price = lambda i: 100 + (1_000 + i) % 1_000 / 100
    assert got == {str(i): ("AFRICA", 1, pytest.approx(2 * price(i))) if i < n else ("ASIA", 1, pytest.approx(price(i))) for i in range(n + 2)}
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("tree") for s in tracker.getJobInfo(j).stageIds]
    tasks = max(s.numTasks for s in stages if s)
    assert tasks == readers.LISTING_TASKS  # one task per folder before
    assert spark.conf.get(readers.LISTING) == held
