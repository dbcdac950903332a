"""Runs a registered query next to its SQL in DuckDB and compares rows and types."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(rows, order):
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    s_cols, d_cols = df.columns, rel.columns
    if sorted(s_cols) != sorted(d_cols):
        return f"columns differ: spark={sorted(s_cols)} sql={sorted(d_cols)}"
    names = sorted(s_cols)
    s_types = dict(df.dtypes)
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    bad = [(n, s_types[n], d_types[n]) for n in names if TYPES.get(s_types[n], s_types[n]) != d_types[n]]
    if bad:
        return f"types differ: {bad}"
    a = _rows(df.collect(), [s_cols.index(n) for n in names])
    b = _rows(rel.fetchall(), [d_cols.index(n) for n in names])
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"row counts differ: spark={len(a)} sql={len(b)} only spark/sql: {str(extra)[:1500]}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference over {names}:\n  spark={str(x)[:900]}\n  sql  ={str(y)[:900]}"
    return None if a else "both empty"
