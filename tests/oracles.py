"""Comparison of a query with its SQL twin in DuckDB over the same Parquet tables."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def twin(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def difference(df, sql: str, sf: str):
    """None if both give the same rows, else a short account."""
    names, rows = twin(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in rows)
    ours = Counter(tuple(plain(x) for x in r) for r in df.select(*sorted(names)).collect())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
