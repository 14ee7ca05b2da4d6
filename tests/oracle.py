"""Compare a query with its SQL on DuckDB, row by row."""

import os

import duckdb


def rows_of_sql(sql: str, sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def _plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return int(v) if type(v).__name__ == "Decimal" else v
