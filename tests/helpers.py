from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb


def canon(v):
    if v is None:
        return ""
    if isinstance(v, float) and not isinstance(v, bool):
        return "%.6f" % v if abs(v) < 1e9 else "%.9g" % v
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    return cols, sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())
