"""Holds a query's rows against DuckDB's for its SQL."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if isinstance(value, bool) else repr(value)


def differences(df, connection, sql):
    """(rows, only in Spark's result, only in the SQL's), the last two as sorted lists."""
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, row)) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, row)) for row in connection.execute(f"SELECT {names} FROM ({sql})").fetchall())
    if ours == theirs:
        return len(ours), [], []
    return len(ours), [x for x in ours if x not in theirs][:3] or ours[:1], [x for x in theirs if x not in ours][:3]
