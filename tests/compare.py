"""Rows of a Spark frame and of DuckDB SQL in one form."""

from __future__ import annotations

import decimal
import math
import os


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sf_dir: str, sql: str):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        path = f"{sf_dir}/{t}"
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), rows(names, result.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
