"""Compare registered queries with their SQL, value by value."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of_spark(frame):
    names = sorted(frame.columns)
    return names, Counter(tuple(row) for row in frame.select(*names).collect())


def rows_of_sql(con, sql):
    result = con.sql(sql)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    return [result.columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in result.fetchall())


def differences(frame, con, sql) -> str | None:
    names, got = rows_of_spark(frame)
    want_names, want = rows_of_sql(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows, {sum(want.values())} wanted, {sum(extra.values())} differ\n"
            f"got    {str(list(extra)[:2])[:800]}\nwanted {str(list(missing)[:2])[:800]}"
        )
    return None
