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
    out = []
    for r in rows:
        out.append(tuple((k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.items())))
    return sorted(out, key=repr)


def agree(df, sql, sf_dir):
    got, want = norm([r.asDict() for r in df.collect()]), norm(sql_rows(sql, sf_dir))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
