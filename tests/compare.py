"""Runs a query and its SQL counterpart and compares all rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("WEIR_TESTDATA", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return value


def oracle(sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(repr(tuple(plain(row[k]) for k in order)) for row in done.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(repr(tuple(plain(row[n]) for n in names)) for row in df.collect())
