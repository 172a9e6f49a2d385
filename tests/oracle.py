"""Runs queries against their SQL in DuckDB on one scale of the test tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(_plain(r[i])) for i in order) for r in data)


def compare(spark, con, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(*(x[1] for x in (got, want))) if a != b]
    assert not bad, bad[:3]
