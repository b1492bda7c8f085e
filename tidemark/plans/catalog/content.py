"""Option quotes, news text and embedding dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vc
from tidemark.operators import news as nw
from tidemark.operators import options as op
from tidemark.operators import tables as tb
from tidemark.operators import volatility as vol
from tidemark.operators.series import BARS, Axis, checked, pct_change, positions, roll_std, windowed
from tidemark.plans.catalog.portfolio import returns
from tidemark.plans.catalog.windows import P, SEL, frame, roll
from tidemark.plans.registry import num, nums, qnum, qnums, query, text, with_ctes
from tidemark.sources import bindings as b


def cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2)))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return f"(0.5::DOUBLE * (1 + sign({x}) * (1 - {poly} * exp(-({x}) * ({x}) / 2))))"


def bs(v: str) -> str:
    d1 = f"((ln(underlying_price / strike) + (0.03::DOUBLE - 0.01::DOUBLE + 0.5::DOUBLE * {v} * {v}) * tau) / ({v} * sqrt(tau)))"
    d2 = f"({d1} - {v} * sqrt(tau))"
    return f"(sg * (underlying_price * exp(-0.01::DOUBLE * tau) * {cdf(f'(sg * {d1})')} - strike * exp(-0.03::DOUBLE * tau) * {cdf(f'(sg * {d2})')}))"


PRICED = f"""qz AS (SELECT *, row_number() OVER (ORDER BY contract_id, expiration, strike) AS id, (expiration - quote_date)::DOUBLE AS dte, (expiration - quote_date) / 365.25 AS tau, strike / underlying_price AS moneyness,
  CASE WHEN option_type = 'call' THEN 1.0::DOUBLE ELSE -1.0 END AS sg FROM quotes), pq AS (SELECT *, {bs("true_iv")} AS price FROM qz)"""


def quotes(spark, d, with_iv=False):
    q = b.option_quotes(spark, d)
    q = op.standardise(q.withColumn("implied_volatility", F.col("true_iv"))) if with_iv else op.standardise(q)
    price = op.black_scholes(F.col("option_type"), F.col("underlying_price"), F.col("strike"), F.col("tau"), F.col("true_iv"), 0.03, 0.01)
    return q.withColumn("mid_price", price)


@query("black_scholes_prices", "O1 O2 O9", with_ctes("quotes", PRICED + f" SELECT contract_id, CAST(expiration AS VARCHAR) AS expiration, {qnums('strike', 'dte', 'tau', 'moneyness')}, {qnum('price', 'price')} FROM pq"))
def black_scholes_prices(spark, d):
    return quotes(spark, d).select("contract_id", text("expiration"), *nums("strike", "dte", "tau", "moneyness"), num("mid_price").alias("price"))


BISECT = PRICED + f""", bz AS (SELECT id, sg, underlying_price, strike, tau, price, 1e-4::DOUBLE AS lo, 5.0::DOUBLE AS hi, NULL::DOUBLE AS iv, 0 AS it FROM pq
   WHERE price > 0 AND price + 1e-6 >= greatest(sg * (underlying_price * exp(-0.01::DOUBLE * tau) - strike * exp(-0.03::DOUBLE * tau)), 0) AND price >= {bs("1e-4::DOUBLE")} - 1e-6 AND price <= {bs("5.0::DOUBLE")} + 1e-6
  UNION ALL SELECT id, sg, underlying_price, strike, tau, price, CASE WHEN gap > 0 THEN lo ELSE mid END, CASE WHEN gap > 0 THEN mid ELSE hi END, CASE WHEN abs(gap) < 1e-6 THEN mid END, it + 1
   FROM (SELECT *, {bs("mid")} - price AS gap FROM (SELECT *, 0.5::DOUBLE * (lo + hi) AS mid FROM bz WHERE iv IS NULL AND it < 100))),
 sv AS (SELECT id, arg_max(coalesce(iv, 0.5::DOUBLE * (lo + hi)), it) AS iv FROM bz GROUP BY id)"""


@query("implied_volatility", "O3", with_ctes("quotes", BISECT + f" SELECT contract_id, CAST(expiration AS VARCHAR) AS expiration, {qnum('strike', 'strike')}, {qnum('iv', 'implied_volatility')}, CASE WHEN iv IS NULL THEN 'missing' ELSE 'model_inverted' END AS iv_source FROM pq LEFT JOIN sv USING (id)"))
def implied_volatility(spark, d):
    q = op.fill_implied_vol(quotes(spark, d), 0.03, 0.01)
    return q.select("contract_id", text("expiration"), num("strike").alias("strike"), num("implied_volatility").alias("implied_volatility"), "iv_source")


CLEAN = """cq AS (SELECT *, row_number() OVER (PARTITION BY quote_date, expiration, strike, option_type ORDER BY contract_id DESC) AS k FROM
   (SELECT *, (expiration - quote_date)::DOUBLE AS dte, (expiration - quote_date) / 365.25 AS tau, strike / underlying_price AS moneyness FROM quotes)
   WHERE expiration - quote_date BETWEEN 10 AND 120 AND strike / underlying_price BETWEEN 0.8 AND 1.2 AND open_interest >= 9), cl AS (SELECT * FROM cq WHERE k = 1)"""


def cleaned(spark, d):
    return op.clean(quotes(spark, d, True), ["contract_id"], (10, 120), (0.8, 1.2), min_open_interest=9)


@query("clean_quotes", "O4 P9 P13", with_ctes("quotes", CLEAN + f" SELECT contract_id, CAST(quote_date AS VARCHAR) AS quote_date, CAST(expiration AS VARCHAR) AS expiration, option_type, {qnum('strike', 'strike')}, {qnum('true_iv', 'iv')} FROM cl"))
def clean_quotes(spark, d):
    return cleaned(spark, d).select("contract_id", text("quote_date"), text("expiration"), "option_type", num("strike").alias("strike"), num("implied_volatility").alias("iv"))


@query("surface_snapshot", "O5", with_ctes("quotes", CLEAN + f""", dy AS (SELECT coalesce(max(quote_date) FILTER (quote_date <= DATE '2024-01-04'), min(quote_date)) AS q FROM cl)
 SELECT contract_id, CAST(expiration AS VARCHAR) AS expiration, {qnum("strike", "strike")} FROM cl, dy WHERE quote_date = q AND option_type = 'call'"""))
def surface_snapshot(spark, d):
    return op.snapshot(cleaned(spark, d), "2024-01-04", "call").select("contract_id", text("expiration"), num("strike").alias("strike"))


@query("surface_grid", "O6", with_ctes("quotes", CLEAN + f""", ce AS (SELECT option_type, CAST(round(moneyness / 0.05) AS INTEGER) AS mi, CAST(round(dte / 15) AS INTEGER) AS ti, avg(true_iv * true_iv * tau) AS w, min(true_iv) AS lo, max(true_iv) AS hi FROM cl GROUP BY 1, 2, 3),
 gb AS (SELECT option_type, min(mi) AS m0, max(mi) AS m1, greatest(min(ti), 1) AS t0, max(ti) AS t1, min(lo) AS lo, max(hi) AS hi FROM ce GROUP BY 1),
 g1 AS (SELECT *, unnest(range(m0, m1 + 1)) AS mi FROM gb), g2 AS (SELECT *, unnest(range(t0, t1 + 1)) AS ti FROM g1),
 nn AS (SELECT g2.option_type, g2.mi, g2.ti, any_value(g2.lo) AS lo, any_value(g2.hi) AS hi, arg_min(ce.w, (ce.mi - g2.mi) * (ce.mi - g2.mi) * 1e9 + (ce.ti - g2.ti) * (ce.ti - g2.ti) * 1e9 + ce.mi * 1e4 + ce.ti) AS w FROM g2 JOIN ce ON ce.option_type = g2.option_type GROUP BY 1, 2, 3)
 SELECT option_type, {qnum("mi * 0.05::DOUBLE", "moneyness")}, {qnum("ti * 15", "dte")}, {qnum("w", "total_variance")}, {qnum("least(greatest(sqrt(w / (ti * 15 / 365.25)), lo), hi)", "implied_volatility")} FROM nn"""))
def surface_grid(spark, d):
    return op.surface_grid(cleaned(spark, d), by=["option_type"]).select("option_type", *nums("moneyness", "dte", "total_variance", "implied_volatility"))


def feat_sql(src: str, by: str, tie: str) -> str:
    return f"""ft AS (SELECT *, abs(moneyness - 1) AS gp FROM {src}), rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY gp, {tie}) AS ka, row_number() OVER (PARTITION BY {by}, expiration ORDER BY gp, {tie}) AS ke FROM ft),
 pe AS (SELECT {by}, expiration, quantile_cont(dte, 0.5) AS d, max(CASE WHEN ke = 1 THEN true_iv END) AS atm FROM rk GROUP BY {by}, expiration),
 po AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d, expiration) AS n1, row_number() OVER (PARTITION BY {by} ORDER BY d DESC, expiration) AS n2 FROM pe),
 te AS (SELECT {by}, max(CASE WHEN n2 = 1 THEN atm END) - max(CASE WHEN n1 = 1 THEN atm END) AS term_slope, count(*) AS expiration_count FROM po GROUP BY {by}),
 fe AS (SELECT {by}, count(*) AS quote_count, quantile_cont(underlying_price, 0.5) AS spot, max(CASE WHEN ka = 1 THEN true_iv END) AS atm_iv, avg(true_iv) AS mean_iv, quantile_cont(true_iv, 0.5) AS median_iv, stddev_samp(true_iv) AS iv_dispersion,
   avg(CASE WHEN moneyness BETWEEN 0.85 AND 0.95 THEN true_iv END) - avg(CASE WHEN moneyness BETWEEN 1.05 AND 1.15 THEN true_iv END) AS skew, min(dte) AS min_dte, max(dte) AS max_dte FROM rk GROUP BY {by})"""


@query("surface_features", "O7 A10", with_ctes("quotes", CLEAN + ", " + feat_sql("cl", "quote_date, option_type", "expiration, strike, contract_id")
 + f" SELECT CAST(quote_date AS VARCHAR) AS quote_date, option_type, quote_count, expiration_count, {qnums('spot', 'atm_iv', 'mean_iv', 'median_iv', 'term_slope')}, {qnum('skew', 'downside_minus_upside_skew')}, {qnums('min_dte', 'max_dte')} FROM fe JOIN te USING (quote_date, option_type)"))
def surface_features(spark, d):
    f = op.surface_features(cleaned(spark, d), ["quote_date", "option_type"], ("expiration", "strike", "contract_id"))
    return f.select(text("quote_date"), "option_type", "quote_count", "expiration_count", *nums("spot", "atm_iv", "mean_iv", "median_iv", "term_slope", "downside_minus_upside_skew", "min_dte", "max_dte"))


@query("underlying_indicators", "O8 P24 J7", with_ctes("quotes bars nb", """ch AS (SELECT *, (expiration - quote_date)::DOUBLE AS dte, strike / underlying_price AS moneyness FROM quotes), """ + feat_sql("ch", "underlying", "expiration, strike, contract_id") + f""",
 px AS (SELECT underlying, sum(CASE WHEN option_type = 'call' THEN 0.01::DOUBLE * volume ELSE 0 END) - sum(CASE WHEN option_type = 'put' THEN 0.01::DOUBLE * volume ELSE 0 END) AS ng, sum(true_iv * volume) AS vv,
   avg(CASE WHEN option_type = 'put' AND moneyness BETWEEN 0.8 AND 0.95 THEN true_iv END) - avg(CASE WHEN option_type = 'call' AND moneyness BETWEEN 1.05 AND 1.2 THEN true_iv END) AS pcs FROM ch GROUP BY underlying),
 rv AS (SELECT symbol, arg_max(rv, ts) AS rv FROM (SELECT symbol, ts, {roll("stddev_samp", "lr", 20)} * sqrt(252) AS rv FROM nb) GROUP BY symbol)
 SELECT underlying, quote_count AS contracts, {qnums("atm_iv", "mean_iv", "iv_dispersion", "term_slope")}, {qnum("ng", "net_gamma_volume", 4)}, {qnum("vv", "vega_volume", 4)}, {qnum("pcs", "put_call_skew")}, {qnum("atm_iv - rv", "iv_minus_rv")}
 FROM fe JOIN te USING (underlying) JOIN px USING (underlying) LEFT JOIN rv ON 'Brand#' || rv.symbol = underlying"""))
def underlying_indicators(spark, d):
    chain = quotes(spark, d).withColumns({"iv": F.col("true_iv"), "gamma": F.lit(0.01), "vega": F.col("true_iv")})
    rv = windowed(returns(spark, d), lambda x, a: x.withColumn("lr", vol.log_return("close", a)).withColumn("rv_close_20", roll_std("lr", a, 20) * F.sqrt(F.lit(252.0))), lookback=21)
    last = rv.groupBy(F.concat(F.lit("Brand#"), "symbol").alias("underlying")).agg(F.max_by("rv_close_20", "ts").alias("rv_close_20"), F.lit(None).cast("double").alias("rv_yang_zhang_20"))
    o = op.underlying_indicators(chain, last)
    return o.select("underlying", "contracts", *nums("atm_iv", "mean_iv", "iv_dispersion", "term_slope"), *nums("net_gamma_volume", "vega_volume", digits=4), *nums("put_call_skew", "iv_minus_rv"))


# --- text ------------------------------------------------------------------------------------


@query("url_dedup", "T2 P8", """WITH k AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?&](utm_[^&]+|ref=[^&]+|source=[^&]+)', '', 'g'), '[?&]$', '', 'g') AS link_key FROM pages)
 SELECT link_key, min(page_id) AS page_id, count(*) AS copies FROM k GROUP BY link_key""")
def url_dedup(spark, d):
    k = b.table(spark, d, "pages").select("page_id", tx.link_key("url").alias("link_key"))
    return k.groupBy("link_key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))


@query("html_body", "T7", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
 c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') AS h FROM a),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS h FROM c),
 l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0), chr(10)) AS body FROM e)
 SELECT page_id, length(body) > 60 AS has_content, CASE WHEN length(body) > 60 THEN md5(body) END AS digest FROM l""")
def html_body(spark, d):
    p = b.table(spark, d, "pages").select("page_id", tx.body_of("html").alias("body"))
    return p.select("page_id", F.col("body").isNotNull().alias("has_content"), F.md5("body").alias("digest"))


@query("news_records", "T1 T3 T6 T8", """WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN ' - Daily ' || source ELSE '' END AS title, lang, source FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_extract(title, '(?s)^.* - (.*?)$', 1)) ELSE trim(regexp_extract(title, '(?s)^.* - (.*?)$', 1)) END AS publisher, '#' || substring(md5(doc_id::VARCHAR || lang || source), 1, 12) AS link,
 '[' || lang || '] ' || CASE WHEN doc_id % 3 = 0 THEN source ELSE 'fallback' END AS filing FROM t""")
def news_records(spark, d):
    n = b.news(spark, d)
    title = F.concat("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - Daily "), "publisher")).otherwise(F.lit("")))
    n = n.withColumn("title", title)
    return n.select("doc_id", tx.publisher_of("title").alias("publisher"), tx.with_link(F.lit(""), "#", "doc_id", "language", "publisher").alias("link"),
                    tx.filing_title("language", F.when(F.col("doc_id") % 3 == 0, F.col("publisher")), F.lit("fallback")).alias("filing"))


@query("multi_format_dates", "T4", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def multi_format_dates(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(
        k == 2, F.date_format(day, "yyyyMMdd'T'HHmmss")).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm"))
    return b.table(spark, d, "orders").select("o_orderkey", tx.any_date(raw).cast("string").alias("day"))


@query("merge_news", "T5 U1 P22", with_ctes("news", """u AS (SELECT ticker, date, trim(title) AS title, 'http://n/' || (doc_id % 400) || '?utm_x=' || doc_id AS url, 0 AS r, doc_id FROM news UNION ALL SELECT ticker, NULL, trim(title), 'http://n/' || (doc_id % 600), -1, doc_id FROM news),
 w AS (SELECT *, regexp_replace(url, '[?&]utm_[^&]+', '', 'g') AS link_key FROM u WHERE date IS NULL OR date BETWEEN DATE '1995-02-01' AND DATE '1996-12-31'),
 k AS (SELECT *, row_number() OVER (PARTITION BY link_key ORDER BY r DESC, date DESC NULLS LAST, title DESC) AS n FROM w)
 SELECT link_key, ticker, CAST(date AS VARCHAR) AS date, md5(title) AS title_md5 FROM k WHERE n = 1"""))
def merge_news(spark, d):
    n = b.news(spark, d)
    first = n.select("ticker", "date", "title", F.concat(F.lit("http://n/"), F.col("doc_id") % 400, F.lit("?utm_x="), "doc_id").alias("url"))
    second = n.select("ticker", F.lit(None).cast("date").alias("date"), "title", F.concat(F.lit("http://n/"), F.col("doc_id") % 600).alias("url"))
    m = nw.merge_sources([first, second], "1995-02-01", "1996-12-31", ("date", "title"))
    return m.select("link_key", "ticker", text("date"), F.md5("title").alias("title_md5"))


@query("coverage_windows", "T9", with_ctes("bars", """s AS (SELECT symbol AS ticker, min(ts) AS a, max(ts) AS z FROM bars GROUP BY symbol),
 w AS (SELECT ticker, z, CAST(unnest(generate_series(a, z, INTERVAL 3 MONTH)) AS DATE) AS ws FROM s)
 SELECT ticker, CAST(ws AS VARCHAR) AS window_start, CAST(least(CAST(ws + INTERVAL 3 MONTH AS DATE) - 1, z) AS VARCHAR) AS window_end FROM w"""))
def coverage_windows(spark, d):
    s = b.bars(spark, d).groupBy(F.col("symbol").alias("ticker")).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return nw.fetch_windows(s, "a", "z", 3).select("ticker", text("window_start"), text("window_end"))


@query("news_covers_prices", "T9", with_ctes("bars news", """n AS (SELECT ticker, min(date) AS a, max(date) AS z FROM news GROUP BY 1), p AS (SELECT symbol AS ticker, min(ts) AS pa, max(ts) AS pz FROM bars GROUP BY 1)
 SELECT ticker, coalesce(a <= pa AND z >= pz, false) AS covered FROM p LEFT JOIN n USING (ticker)"""))
def news_covers_prices(spark, d):
    p = b.bars(spark, d).withColumnRenamed("symbol", "ticker")
    return nw.coverage(b.news(spark, d), p).select("ticker", "covered")


@query("sentiment_classes", "T15", with_ctes("sentiment", """SELECT doc_id, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS sentiment,
 """ + qnum("greatest(positive, negative, neutral)", "confidence") + ", " + qnum("positive - negative", "balance") + " FROM sentiment"))
def sentiment_classes(spark, d):
    s = b.sentiment(spark, d).withColumns(nw.sentiment_class())
    return s.select("doc_id", "sentiment", *nums("confidence", "balance"))


@query("sentiment_default_fill", "T17 T19", with_ctes("bars sentiment", f"""s AS (SELECT ticker AS symbol, date AS ts, avg(positive) AS p FROM sentiment GROUP BY 1, 2)
 SELECT symbol, CAST(ts AS VARCHAR) AS ts, {qnum("coalesce(p, 1.0::DOUBLE / 3)", "positive")}, p IS NOT NULL AS has_text FROM bars LEFT JOIN s USING (symbol, ts)"""))
def sentiment_default_fill(spark, d):
    s = b.sentiment(spark, d).groupBy(F.col("ticker").alias("symbol"), F.col("date").alias("ts")).agg(F.avg("positive").alias("p"))
    j = b.bars(spark, d).select("symbol", "ts").join(s, ["symbol", "ts"], "left")
    return j.select("symbol", text("ts"), num(F.coalesce("p", F.lit(1 / 3))).alias("positive"), F.col("p").isNotNull().alias("has_text"))


@query("news_forward_returns", "T16 J2 W19", with_ctes("bars sentiment", f"""p AS (SELECT symbol, ts, close, {", ".join(f"lead(close, {h}) OVER ({P}) / close - 1 AS r{h}" for h in (1, 5, 20))} FROM bars),
 a AS (SELECT s.*, p.r1, p.r5, p.r20 FROM (SELECT ticker AS symbol, date AS ts, positive, negative, positive - negative AS balance FROM sentiment) s ASOF LEFT JOIN p ON s.symbol = p.symbol AND s.ts <= p.ts),
 f AS (SELECT *, unnest([1, 5, 20]) AS horizon, unnest([r1, r5, r20]) AS ret FROM a)
 SELECT horizon, count(*) AS n, {qnum("corr(positive, ret)", "corr_positive")}, {qnum("corr(balance, ret)", "corr_balance")}, {qnum("avg(CASE WHEN (balance >= 0) = (ret > 0) THEN 1.0::DOUBLE ELSE 0 END)", "directional_accuracy")},
 {qnum("avg(CASE WHEN balance > 0 THEN ret END)", "mean_when_positive")}, {qnum("avg(CASE WHEN balance < 0 THEN ret END)", "mean_when_negative")} FROM f WHERE ret IS NOT NULL GROUP BY horizon"""))
def news_forward_returns(spark, d):
    s = b.sentiment(spark, d).select(F.col("ticker").alias("symbol"), F.col("date").alias("ts"), "positive", "negative", (F.col("positive") - F.col("negative")).alias("balance"))
    g = nw.return_statistics(nw.return_alignment(s, b.bars(spark, d)))
    return g.select("horizon", "n", *nums("corr_positive", "corr_balance", "directional_accuracy", "mean_when_positive", "mean_when_negative"))


# --- embeddings ------------------------------------------------------------------------------

EMB = Axis(("ticker",), ("day",))
DIST = "sqrt(list_sum(list_transform(list_zip(emb, pv), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))"


@query("embedding_drift", "T11 T12 T22 A11", with_ctes("emb", f"""l AS (SELECT *, lag(emb) OVER (PARTITION BY ticker ORDER BY day) AS pv FROM emb), d AS (SELECT ticker, day, CASE WHEN pv IS NULL THEN 0 ELSE {DIST} END AS drift, sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM l),
 q AS (SELECT quantile_cont(drift, 0.95) AS q FROM d WHERE day < 35 AND drift > 0)
 SELECT ticker, day, {qnum("drift", "drift")}, CASE WHEN drift >= q THEN 1 ELSE 0 END AS drift_event, {qnum("CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(nrm) OVER w END", "semantic_vol", 5)} FROM d, q WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def embedding_drift(spark, d):
    df = nw.drift(b.embeddings(spark, d), "emb", EMB).withColumn("nrm", vc.norm("emb"))
    df = nw.drift_events(df, "drift", F.col("day") < 35)
    df = windowed(df, lambda x, a: x.withColumn("semantic_vol", roll_std("nrm", a, 10)), EMB, lookback=10)
    return df.select("ticker", "day", num("drift").alias("drift"), "drift_event", num("semantic_vol", 5).alias("semantic_vol"))


@query("decay_context", "T10 J12 scan", with_ctes("emb", f"""p AS (SELECT a.ticker, a.day, l, x.day AS d2, x.emb, exp(-l * (a.day - x.day)) AS w FROM emb a JOIN emb x ON x.ticker = a.ticker AND x.day < a.day, (SELECT unnest([0.1::DOUBLE, 0.5]) AS l)),
 u AS (SELECT ticker, day, l, w, unnest(range(64)) AS i, unnest(emb)::DOUBLE AS v FROM p)
 SELECT ticker, day, {qnum("l", "rate")}, CAST(i AS INTEGER) AS pos, {qnum("sum(w * v) / sum(w)", "value")} FROM u GROUP BY ticker, day, l, i"""))
def decay_context(spark, d):
    df = nw.decay_context(b.embeddings(spark, d).select("ticker", "day", "emb"), "emb", "day", [0.1, 0.5], EMB, 64)
    both = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"context_{i}").alias("v")) for i, r in enumerate((0.1, 0.5))])
    df = df.select("ticker", "day", F.explode(both).alias("e")).select("ticker", "day", "e.rate", F.posexplode("e.v").alias("pos", "value"))
    return df.select("ticker", "day", num("rate").alias("rate"), "pos", num("value").alias("value"))


@query("carry_forward_embedding", "T13 P18 P5", with_ctes("emb", f"""k AS (SELECT ticker, day, CASE WHEN label > 2 THEN emb END AS emb FROM emb), g AS (SELECT ticker, unnest(range(lo, hi + 1)) AS day FROM (SELECT ticker, min(day) AS lo, max(day) AS hi FROM k GROUP BY ticker)),
 f AS (SELECT g.ticker, g.day, last_value(k.emb IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.day ROWS UNBOUNDED PRECEDING) AS e FROM g LEFT JOIN k USING (ticker, day))
 SELECT ticker, CAST(day AS INTEGER) AS day, {qnum("e[1]", "first_value")}, {qnum("list_sum(list_transform(e, lambda x: x::DOUBLE))", "total")} FROM f"""))
def carry_forward_embedding(spark, d):
    k = b.embeddings(spark, d).select("ticker", "day", F.when(F.col("label") > 2, F.col("emb")).alias("emb"))
    grid = k.groupBy("ticker").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("ticker", F.explode(F.sequence("lo", "hi")).alias("day"))
    df = tb.forward_fill(grid.join(k, ["ticker", "day"], "left"), ["emb"], EMB)
    return df.select("ticker", "day", num(F.get("emb", F.lit(0))).alias("first_value"), num(vc.total(vc.doubles("emb"))).alias("total"))


@query("numeric_drift", "T14", with_ctes("bars nb", f"""f AS (SELECT symbol, ts, coalesce({roll("stddev_samp", "ret", 5)}, 0) AS a, coalesce({roll("avg", "ret", 10)}, 0) AS b, coalesce({roll("stddev_samp", "ret", 20)}, 0) AS c, coalesce(ret, 0) AS d FROM nb)
 {SEL}, {qnum("coalesce(sqrt(pow(a - lag(a) OVER w, 2) + pow(b - lag(b) OVER w, 2) + pow(c - lag(c) OVER w, 2) + pow(d - lag(d) OVER w, 2)), 0)", "drift")} FROM f WINDOW w AS ({P})"""))
def numeric_drift(spark, d):
    return nw.numeric_drift(returns(spark, d), "ret").select("symbol", text("ts"), num("drift").alias("drift"))


@query("similarity_surprise", "T20 T23", with_ctes("emb", f"""l AS (SELECT ticker, day, list_transform(emb, lambda x: x::DOUBLE) AS a, list_transform(lag(emb) OVER (PARTITION BY ticker ORDER BY day), lambda x: x::DOUBLE) AS b FROM emb),
 e AS (SELECT *, list_transform(a, lambda x: exp(x - list_max(a))) AS ea, list_transform(b, lambda x: exp(x - list_max(b))) AS eb FROM l WHERE b IS NOT NULL),
 s AS (SELECT *, list_transform(ea, lambda x: x / list_sum(ea)) AS pa, list_transform(eb, lambda x: x / list_sum(eb)) AS pb FROM e)
 SELECT ticker, day, {qnum("list_cosine_similarity(a, b)", "cosine", 5)}, {qnum("1 - list_cosine_similarity(a, b)", "surprise", 5)}, {qnum("list_sum(list_transform(list_zip(pa, pb), lambda z: z[1] * (ln(z[1]) - ln(z[2]))))", "kl")} FROM s"""))
def similarity_surprise(spark, d):
    df = windowed(b.embeddings(spark, d), lambda x, a: x.withColumn("pv", F.lag("emb").over(a.spec())), EMB, lookback=1).where("pv IS NOT NULL")
    c = vc.cosine("emb", "pv")
    return df.select("ticker", "day", num(c, 5).alias("cosine"), num(1 - c, 5).alias("surprise"), num(vc.kl_divergence("emb", "pv")).alias("kl"))


@query("batch_similarity", "T20", with_ctes("emb", f"""n AS (SELECT day, ticker, list_transform(emb, lambda x: x::DOUBLE) AS e FROM emb)
 SELECT a.day, a.ticker, {qnum("sum(list_cosine_similarity(a.e, b.e))", "row_sum", 5)}, count(*) AS members FROM n a JOIN n b ON a.day = b.day GROUP BY 1, 2"""))
def batch_similarity(spark, d):
    s = nw.batch_similarity(b.embeddings(spark, d).select("day", "ticker", "emb"), "day", "ticker", "emb")
    return s.select("day", "ticker", num(vc.total("similarities"), 5).alias("row_sum"), F.size("similarities").cast("long").alias("members"))


@query("trailing_sequences", "T21 F3", with_ctes("bars", f"""s AS (SELECT *, row_number() OVER ({P}) AS rn FROM bars), w AS (SELECT a.symbol, a.ts, list(x.close ORDER BY x.ts) AS v, avg(x.close) AS m, stddev_pop(x.close) AS sd FROM s a JOIN s x ON x.symbol = a.symbol AND x.rn BETWEEN a.rn - 15 AND a.rn WHERE a.rn >= 16 GROUP BY a.symbol, a.ts)
 {SEL}, len(v) AS n, {qnum("(v[1] - m) / sd", "first_z")}, {qnum("(v[16] - m) / sd", "last_z")} FROM w"""))
def trailing_sequences(spark, d):
    df = nw.trailing_sequences(b.bars(spark, d).select("symbol", "ts", "close"), ["close"], 16)
    return df.select("symbol", text("ts"), F.size("seq_close").cast("long").alias("n"), num(F.get("seq_close", F.lit(0))).alias("first_z"), num(F.get("seq_close", F.lit(15))).alias("last_z"))
