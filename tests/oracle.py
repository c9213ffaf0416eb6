"""Run a query and its SQL twin and compare the rows."""

import glob
import os

import duckdb


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def norm(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    """Number of rows, or an error that shows the first rows that differ."""
    got, want = norm([r.asDict() for r in df.collect()]), norm(sql_rows(sql, sf_dir))
    assert len(got) == len(want), f"{len(got)} rows, SQL has {len(want)}"
    for a, b in zip(got, want):
        assert a == b, f"\n{a}\n{b}"
    return len(got)
