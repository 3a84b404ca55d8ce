"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same rows."""
    cursor = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {str(g)[:600]} instead of {str(w)[:600]}"
    if not got:
        return "no rows"
    return None
