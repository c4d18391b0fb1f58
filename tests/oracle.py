"""Compare a query's rows with those of SQL in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def plain(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    return repr(value) if isinstance(value, float) else str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(db, sql):
    out = db.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return [out.columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in out.fetchall())
