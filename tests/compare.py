"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def differences(spark, con, folder: str, fn, sql: str) -> str | None:
    """None if both sides agree, else a short description."""
    scols, srows = spark_rows(fn(spark, folder))
    dcols, drows = duck_rows(con, sql)
    if scols != dcols:
        return f"columns {scols} != {dcols}"
    if srows != drows:
        only_s, only_d = srows - drows, drows - srows
        return (
            f"rows {sum(srows.values())} vs {sum(drows.values())}; only spark {sum(only_s.values())}: "
            f"{list(only_s)[:2]}; only sql {sum(only_d.values())}: {list(only_d)[:2]}"
        )
    return None
