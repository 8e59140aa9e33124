"""Compare a query with its SQL oracle: columns, row count and values in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sql, sf_dir) -> str | None:
    frame = query(spark, sf_dir)
    relation = con.sql(sql)
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} <> {sorted(relation.columns)}"
    ours = _rows([tuple(r) for r in frame.collect()], frame.columns)
    theirs = _rows(relation.fetchall(), relation.columns)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows <> {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} <> {b}"[:2000]
    return None
