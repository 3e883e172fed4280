"""Compare a query's rows with DuckDB's."""

import glob
import os

import duckdb


def rows_of(sql: str, folder: str) -> list[dict]:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    c = con.execute(sql)
    names = [x[0] for x in c.description]
    return [dict(zip(names, r, strict=True)) for r in c.fetchall()]


def same(df, sql: str, folder: str) -> None:
    got, want = [r.asDict() for r in df.collect()], rows_of(sql, folder)
    assert sorted(df.columns) == sorted(want[0] if want else df.columns)
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want))
