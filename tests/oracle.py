"""Run a query's SQL in DuckDB and compare the two results."""

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def spark_result(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return _rows(names, cur.fetchall())
