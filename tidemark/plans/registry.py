"""The registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it exercises."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def num(c: Column | str, digits: int = 6) -> Column:
    """A double for comparison: rounded, NaN and infinities null, no negative zero.

    Half-way decimals are common (prices have two decimals), and two engines may round them apart by
    one unit; a shift far below the kept digits moves them off the boundary on both sides alike.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < 1e300), F.round(c + nudge(digits), digits) + 0.0)


def nudge(digits: int) -> float:
    return 1.37 * 10.0 ** -(digits + 1)


def nums(*names: str, digits: int = 6) -> list[Column]:
    return [num(n, digits).alias(n) for n in names]


def qnum(expr: str, name: str, digits: int = 6) -> str:
    return (
        f"CASE WHEN isfinite(CAST({expr} AS DOUBLE)) THEN "
        f"round(CAST({expr} AS DOUBLE) + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0 END AS {name}"
    )


def qnums(*names: str, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(qnum(prefix + n, n, digits) for n in names)


def text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


# ---------------------------------------------------------------------------------------------
# shared SQL prelude: the same bindings, written for the checker

CTES = {
    "bars": """bars AS (
 SELECT r_name AS asset_group, CAST(l_suppkey AS VARCHAR) AS symbol, ts,
  arg_min(price, arrival) AS open, max(price) AS high, min(price) AS low, arg_max(price, arrival) AS close,
  sum(l_quantity) AS volume
 FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS ts, 100 + (l_extendedprice % 1000) / 100 AS price,
        l_orderkey * 10 + l_linenumber AS arrival, l_quantity FROM lineitem)
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
 JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, l_suppkey, ts)""",
    "nb": """nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
 close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret,
 ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr,
 lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)""",
    "intraday": """intraday AS (
 SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
  CAST(date_trunc('hour', ts) AS DATE) AS day
 FROM events GROUP BY event_type, date_trunc('hour', ts))""",
    "trades": """trades AS (
 SELECT event_type AS symbol, event_id AS trade_id, ts AS trade_time, 100 + value / 10 AS price,
  value AS quantity, event_id % 2 = 1 AS is_buyer_maker, (100 + value / 10) * value AS quote_qty FROM events)""",
    "slow": """slow AS (
 SELECT CAST(o_custkey % 100 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS ts,
  arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2)""",
    "news": """news AS (
 SELECT doc_id, CAST(doc_id % 100 AS VARCHAR) AS ticker, DATE '1995-01-02' + CAST(doc_id AS INTEGER) AS date,
  split_part(text, chr(10), 1) AS title, text AS summary, lang AS language, source AS publisher FROM documents)""",
    "emb": """emb AS (
 SELECT vec_id, CAST(vec_id % 10 AS VARCHAR) AS ticker, CAST(vec_id // 10 AS INTEGER) AS day, embedding AS emb, label
 FROM embeddings)""",
    "sentiment": """sentiment AS (
 SELECT doc_id, CAST(doc_id % 100 AS VARCHAR) AS ticker, DATE '1995-01-02' + CAST(doc_id AS INTEGER) AS date,
  0.5::DOUBLE * quality AS positive, 0.5::DOUBLE * toxic AS negative,
  1 - 0.5::DOUBLE * quality - 0.5::DOUBLE * toxic AS neutral FROM labels)""",
    "quotes": """quotes AS (
 SELECT p_brand AS underlying, p_partkey AS contract_id, DATE '2024-01-02' + CAST(p_partkey % 5 AS INTEGER) AS quote_date,
  DATE '2024-01-02' + CAST(p_partkey % 5 + dte AS INTEGER) AS expiration, p_retailprice * m AS strike,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type, p_retailprice AS underlying_price,
  0.2::DOUBLE + 0.1::DOUBLE * pow(m - 1, 2) + 0.0002::DOUBLE * dte + 0.001::DOUBLE * p_size AS true_iv,
  CAST(p_size AS DOUBLE) AS volume, CAST(p_size * 3 AS DOUBLE) AS open_interest
 FROM part, (SELECT unnest([7, 30, 60, 90, 180]) AS dte), (SELECT unnest([0.75::DOUBLE, 0.9, 1.0, 1.1, 1.25]) AS m))""",
}


def with_ctes(names: str, body: str) -> str:
    """``names``: space-separated prelude CTEs; ``body`` may start with more CTEs (``x AS (...)``)."""
    head = ",\n".join(CTES[n] for n in names.split())
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH RECURSIVE {head}\n{body}"
    return f"WITH RECURSIVE {head},\n{body}"


def ewm_sql(source: str, specs: dict[str, tuple[str, float]], out: str = "ew") -> str:
    """Recursive CTE for exponential means (first value starts, nulls age the weight).

    ``source`` has symbol, rn (from 1) and the input columns; ``specs`` maps output → (input, alpha).
    The caller joins on (symbol, rn).
    """
    first = ", ".join(f"{x} AS {n}, CASE WHEN {x} IS NULL THEN NULL ELSE 1.0::DOUBLE END AS {n}_w" for n, (x, _) in specs.items())
    nxt = ", ".join(
        f"""CASE WHEN s.{x} IS NULL THEN r.{n} WHEN r.{n} IS NULL THEN s.{x}
 ELSE (r.{n}_w * {1 - a!r}::DOUBLE * r.{n} + {a!r}::DOUBLE * s.{x}) / (r.{n}_w * {1 - a!r}::DOUBLE + {a!r}::DOUBLE) END,
 CASE WHEN s.{x} IS NULL THEN r.{n}_w * {1 - a!r}::DOUBLE ELSE 1.0::DOUBLE END"""
        for n, (x, a) in specs.items()
    )
    return (
        f"{out} AS (SELECT symbol, rn, {first} FROM {source} WHERE rn = 1 UNION ALL "
        f"SELECT s.symbol, s.rn, {nxt} FROM {out} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"
    )
