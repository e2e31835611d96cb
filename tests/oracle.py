"""Compare a report with its SQL statement on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(os.path.join(path, "*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return v + 0.0  # no negative zero
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, type(x).__name__, f"{x:.9e}" if isinstance(x, float) else str(x)) for x in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, _sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()])


def sql_rows(con, text):
    rel = con.sql(text)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, _sorted([tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()])


def difference(got, want, rel=0.0, tol=0.0) -> str:
    """Empty text when equal; otherwise what differs first."""
    (gc, gr), (wc, wr) = got, want
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}; first {gr[:1]} / {wr[:1]}"
    bad = []
    for g, w in zip(gr, wr):
        for c, a, b in zip(gc, g, w):
            if a is None and b is None:
                continue
            if type(a) is not type(b):
                return f"{c}: {a!r} ({type(a).__name__}) != {b!r} ({type(b).__name__})"
            if a != b and not (isinstance(a, float) and math.isclose(a, b, rel_tol=rel, abs_tol=tol)):
                bad.append((c, a, b, g, w))
    if bad:
        c, a, b, g, w = bad[0]
        return f"{len(bad)} cells; {c}: {a!r} != {b!r}\n   {dict(zip(gc, g))}\n   {dict(zip(wc, w))}"
    return ""
