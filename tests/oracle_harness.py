"""Compare a Spark query with its DuckDB oracle the way the driver does:
row count, column names, column types, order-insensitive values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Return a list of differences (empty when equal)."""
    problems = []
    s_cols = spark_df.columns
    s_types = [f.dataType.simpleString() for f in spark_df.schema.fields]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns differ: spark={s_cols} oracle={d_cols}"]
    for c, st in zip(s_cols, s_types):
        dtp = d_types[d_cols.index(c)]
        want = SPARK_TO_DUCK.get(st, st.upper())
        if want != dtp:
            problems.append(f"type of {c}: spark={st} oracle={dtp}")
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    s_rows = [tuple(_norm(x) for x in r) for r in spark_df.collect()]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} oracle={len(d_rows)}")
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        problems.append(f"values differ: spark-only={only_s} oracle-only={only_d}")
    return problems


def order_problems(df, columns: list[str]) -> list[str]:
    """Neighbouring rows that break the order ("-" before a name: descending;
    NULL sorts lowest)."""
    def key(row, c):
        v = row[c.lstrip("-")]
        return (v is not None, v if v is not None else 0)
    rows = df.collect()
    out = []
    for a, b in zip(rows, rows[1:]):
        for c in columns:
            x, y = key(a, c), key(b, c)
            if x != y:
                if (x > y) != c.startswith("-"):
                    out.append(f"{a} before {b}")
                break
    return out
