"""Comparing a query with its SQL on the test tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())


def rows_of_sql(con, sql: str) -> Counter:
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return Counter(repr(tuple(plain(r[k]) for k in at)) for r in found.fetchall())
