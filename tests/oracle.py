"""Runs a query and its SQL side by side and compares the rows, whatever their order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql):
    """None, or what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    cols = sorted(names)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in result.fetchall())
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; only ours {[x for x in ours if x not in b][:2]}; only theirs {[x for x in theirs if x not in a][:2]}"
