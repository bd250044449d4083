"""Registered queries against their SQL, run by DuckDB over the same files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def differences(df, db, sql):
    """None if both give the same columns and rows, else what differs."""
    got = df.collect()
    names = sorted(df.columns)
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    want = [dict(zip(columns, row)) for row in result.fetchall()]
    key = lambda r: tuple(repr(v) for v in r)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got), key=key)
    b = sorted((tuple(plain(r[n]) for n in names) for r in want), key=key)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows of {names}: {only_a} and {only_b}"
    return None
