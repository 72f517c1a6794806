"""Compare a query's rows with its checking SQL (order-insensitive)."""

import math
import os

import duckdb

from wardlight.sources.adapters import TABLES


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__, v) if not isinstance(v, float)
                 else (False, "float", -1e300 if math.isnan(v) else v) for v in row)


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return str(v)


def compare(df, con, sql):
    """Returns (n_rows, problem or None)."""
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(got), f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted([tuple(_norm(r[i]) for i in order) for r in cur.fetchall()], key=repr)
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}; extra {[r for r in got if r not in set(want)][:2]} missing {[r for r in want if r not in set(got)][:2]}"
    for a, b in zip(got, want):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return len(got), f"differs: {bad[:4]}"
        if [type(x) for x in a] != [type(y) for y in b]:
            return len(got), f"types: {[(c, type(x), type(y)) for c, x, y in zip(cols, a, b) if type(x) != type(y)][:4]}"
    return len(got), None
