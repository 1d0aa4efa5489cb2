"""Comparison of a query with its SQL: names, rows and values, sorted."""

import math
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def differences(df, sql: str, db) -> str:
    """Empty if the query gives what the SQL gives."""
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    types = {d[0]: str(d[1]) for d in want.description}
    for f in df.schema:
        if KINDS.get(f.dataType.simpleString()) != types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} against {types[f.name]}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)
    a = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=str)
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} rows against {len(b)}; {order}; first odd: {odd}"
