"""Compare a query with its SQL on the same tables."""

import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def differences(frame, con, sql):
    """Text about what differs, or nothing."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if decimals := [d[0] for d in cursor.description if "DECIMAL" in str(d[1])]:
        return f"decimals in {decimals}"
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(row[names.index(n)]) for n in order) for row in cursor.fetchall())
    ours = Counter(tuple(plain(row[n]) for n in order) for row in frame.collect())
    if ours == theirs:
        return ""
    more, less = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(more)[:3]}; only theirs {list(less)[:3]} ({order})"
