"""Compares a query with its SQL over the same Parquet tables."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"
HERE = os.path.isdir(FOLDER)


def _plain(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    return str(v)


def rows_of_sql(sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def rows_of_query(spark, query) -> tuple[list[str], list[tuple]]:
    df = query(spark, FOLDER)
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
